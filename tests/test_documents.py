"""Documents, text functions, flows and reports on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text as texts
from auditlake.operators import markdown, report
from auditlake.plans import scan
from auditlake.sources import records


def test_front_matter():
    assert markdown.front_matter("---\nname: a\nlist:\n  - b\n---\nx") == ({"name": "a", "list": ["b"]}, {"name": 2, "list": 3}, 5, [])
    assert markdown.front_matter("no") == ({}, {}, 0, []) and markdown.front_matter("---\na: 1")[3] == ["frontmatter_unterminated"] and markdown.front_matter("---\n---\n") == ({}, {}, 2, [])
    assert markdown.front_matter("---\na: &x 1\nb: *x\n---\n")[3] == ["yaml_alias_budget"] and markdown.front_matter("---\n- a\n---\n")[3] == ["frontmatter_not_a_mapping"]
    assert markdown.front_matter("---\na: [\n---\n")[3][0].startswith("yaml_error") and markdown.front_matter("---\n" + "a: b\n" * 5000 + "---\n")[3] == ["frontmatter_too_large"]
    assert markdown.unsafe_tags("---\na: !!python/object:x {}\nb: !!str 1\n---\n") == [("!!python/object:x", 2, 4)] and markdown.front_matter("---\nd: 2020-01-01\n---\n")[0] == {"d": "2020-01-01"}


def test_blocks_and_links():
    text = "# T\n\npara\nmore\n\n- a\n- b\n\n```py\nx = [l](no)\n```\n\n    code\n\n> q\n\n|a|b|\n|-|-|\n|1|2|\n\nHead\n====\n\n[x]: y\n\n<!-- c\nd -->\nsee [l](a.md \"t\") and `[no](x)`\n"
    kinds = [(k, a, b) for k, a, b, _ in markdown.blocks(text)]
    assert kinds == [("heading", 1, 1), ("prose", 3, 4), ("list", 6, 7), ("fence", 9, 11), ("code", 13, 13), ("quote", 15, 15), ("table", 17, 19), ("heading", 21, 22), ("reference", 24, 24), ("html", 26, 27), ("prose", 28, 28)]
    assert markdown.links(text) == [("a.md", 28)] and markdown.comments(text) == [(" c\nd ", 26, 1)] and markdown.blocks("") == [] and markdown.blocks("```\nopen")[0][:3] == ("fence", 1, 2)


def test_load_time_commands():
    got = markdown.bang_tokens("!`a` x!`b` y !`c`\n| t |\n|---|\n| !`d` |\n```\n!`e`\n```\n```! sh\nls\n```\n```!\n\n```\n``!`f` ``\n")
    assert [(k, c, runs) for k, c, _, _, runs in got] == [("fenced", "ls", True), ("inline", "a", True), ("inline", "b", False), ("inline", "c", True)]
    assert len(markdown.bang_tokens("!`a` " * 60)) == 60
    kept = scan._preproc("a.md", "doc", "!`a` " * 60, None)
    assert len(kept) == 26 and kept[-1][2:5] == ("findings-capped", "low", "preproc-inline-bang: 35 more")


def test_code_units():
    got = markdown.code_units("a.md", "t\n```bash\n$ ls\n```\n```py\nx\n```\n```sh\nb\n```\n```text\nno\n```")
    assert got == [("shell", "fence", "\n\nls\n\n\n\n\n\nb"), ("python", "fence", "\n\n\n\n\nx")]


def test_text_functions(spark):
    df = spark.createDataFrame([(" \x1cab ", "a/.x.tar.gz", "HTTPS://u:p@Host.Example:8/x?y#z", "a\n  b")], "s string, p string, u string, t string")
    r = df.select(texts.strip(F.col("s")), texts.split_extension(F.col("p")), texts.url_host(F.col("u")), texts.clean_source(F.col("u")), texts.flatten(F.col("t")), texts.split_extension(F.lit(".env")), texts.head(F.col("p"), 3)).first()
    assert tuple(r) == ("ab", ".gz", "host.example", "HTTPS://Host.Example:8/x", "a b", "", "a/.")
    p = spark.createDataFrame([("token = 'abcdef123456'\nBearer abcdefghijklmnop\nhttps://u:pw@h/x\nplain",), (None,)], "t string").select(texts.privacy(F.col("t")).alias("t")).collect()
    assert p[0].t == "token = '[redacted]'\nBearer [redacted]\nhttps://[redacted]@h/x\nplain" and p[1].t is None
    g = spark.createDataFrame([("Straße",), (None,)], "t string").select(texts.casefold("t").alias("c"), texts.python_repr("t").alias("r"), texts.split_lines("t").alias("l")).collect()
    assert tuple(g[0]) == ("strasse", "'Straße'", ["Straße"]) and tuple(g[1]) == (None, None, None)
    assert texts.canonical('{"b": 1, "a": "é"}') == '{"a":"\\u00e9","b":1}' and texts.canonical("{") is None and texts.shell_words("a 'b c'") == ["a", "b c"] and texts.shell_words("'") is None
    assert [texts.public_address(a) for a in ("8.8.8.8", "10.0.0.1", "::1", "64:ff9b::808:808", "::ffff:127.0.0.1", "x")] == [True, False, False, True, False, None]
    assert [texts.exact_pin(a) for a in ("@a/b@1.2.3", "a==1.0", "a@latest", "@a/b", "a@^1.2")] == [True, True, False, False, False]
    assert texts.prompts('{"a": [{"prompt": "x", "n": 1}], "text": "y"}') == [("a[0].prompt", "x"), ("text", "y")]


def test_policy_and_claims():
    d = {"rule_id": "r", "path": "a", "fingerprint": "0" * 64, "context_digest": "1" * 64, "action": "suppress", "reason": "ok"}
    assert report.check_policy({"version": "1", "decisions": [d]}) == [d]
    for bad in ({"path": "../a"}, {"fingerprint": "x"}, {"action": "demote"}, {"action": "none"}, {"reason": "r" * 2000}, {"extra": "x"}):
        with pytest.raises(ValueError):
            report.check_policy({"version": "1", "decisions": [d | bad]})
    with pytest.raises(ValueError):
        report.check_policy({"version": "1", "decisions": [d, d]})
    assert report.claims("This skill does not run any commands. It uses the network.") == ({"execution": "denied", "network": "present"}, []) and report.claims("It formats text nicely.") == ({}, ["claim_unrecognised"]) and report.claims(None) == ({}, [])
    assert report.claims("It makes no network requests. It uses the network.") == ({}, ["claim_conflict:network"])


def test_reports(spark):
    f = spark.createDataFrame([("p", "b", "V", "r", "low", 2), ("p", "a", "V", "q", "high", None)], "pkg_id string, path string, vector string, rule string, severity string, line_no int")
    r = report.package_reports(f).first()
    assert r.n_results == 2 and r.report == '{"rules":["q","r"],"results":[{"ruleId":"q","level":"high","uri":"a"},{"ruleId":"r","level":"low","uri":"b","startLine":2}]}'
    links = spark.createDataFrame([("1", "x"), ("2", "y")], "result_id string, candidate_id string")
    assert report.dangling(links, links.select("result_id"), links.select("candidate_id").where("candidate_id = 'x'")).collect()[0].asDict() == {"kind": "candidate", "id": "y"}


def test_merged_reports_and_policy_files(spark, tmp_path):
    rows = [("b", '{"rules":["r"],"results":[{"ruleId":"r"}]}'), ("a", '{"rules":[],"results":[]}'), ("c", None)]
    df = spark.createDataFrame(rows, "pkg_id string, report string")
    assert records.write_merged(df, str(tmp_path / "all.json")) == 2
    doc = json.loads((tmp_path / "all.json").read_text())
    assert [r["automationDetails"]["id"] for r in doc["runs"]] == ["a", "b"] and doc["runs"][1]["results"] == [{"ruleId": "r"}] and doc["version"] == "2.1.0"
    assert records.write_merged(df.where("false"), str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text())["runs"] == []
    with pytest.raises(ValueError):
        records.encode({"a": "x" * (records.MAX_REPORT + 1)})
    policy = tmp_path / "policy.json"
    policy.write_text(json.dumps({"version": "1", "decisions": []}))
    assert report.read_policy(str(policy)) == []
    (tmp_path / "link.json").symlink_to(policy)
    for path, outside in ((tmp_path / "link.json", None), (tmp_path, None), (policy, str(tmp_path))):
        with pytest.raises(ValueError):
            report.read_policy(str(path), outside)
    policy.write_text(" " * (513 << 10))
    with pytest.raises(ValueError):
        report.read_policy(str(policy))
