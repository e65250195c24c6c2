"""Queries over tables of hand-written cases: operators that SQL cannot express, against answers written down beside their inputs.

The input rows become a DataFrame, the operator runs over it as it does over any
table, and the SQL of the query is the table of expected rows.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bidi, requirements
from ..functions import text as texts
from ..operators import correlate, detect, engine, engine_python, engine_report, findings, forensics, graph, hooks, inspect, instruction, markdown, parsing, report, review, scoring, shell_tree
from ..operators.inspect import _map
from ..sources import packages, records
from . import cases
from .queries import ORACLE_SQL, QUERIES


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return str(v)
    out = "'" + str(v).replace("'", "''") + "'"
    for c in sorted({c for c in str(v) if c < " "}):
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})"


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def expect(columns: str, rows: list[tuple]):
    """Register a query whose answer must be ``rows`` with ``columns`` (names and types as in DDL)."""
    names = [c.split() for c in columns.split(", ")]
    shown = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in names)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"SELECT {shown} FROM (VALUES {values}) t({', '.join(n for n, _ in names)})"
        return f

    return add


def given(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def each(spark: SparkSession, rows: list[tuple], columns: str, fn, schema: str) -> DataFrame:
    """``fn(*values) -> tuples`` over the rows of a case table."""
    return _map(given(spark, rows, columns), [c.split()[0] for c in columns.split(", ")], fn, schema)


# -- code and directives ---------------------------------------------------------------------------------

_CODE_ROWS, _CODE_WANT = cases.code_cases()
_CAPABILITY = {"E60", "E61", "E62", "E63", "E72", "E73"}


@expect("name string, rule string, line_no int", [(c, engine.CODE_RULES[r].rule, n) for c, r, n in _CODE_WANT])
def e_code_rule_cases(spark, sf_dir):
    """Every code rule on its positives and near misses; capabilities have cases of their own."""
    found = engine.code_findings(given(spark, [(c, c, k, t) for c, k, t in _CODE_ROWS], "pkg_id string, rel string, kind string, text string"))
    own = F.col("path").startswith("capability") | ~F.substring("rule", 1, 3).isin(*_CAPABILITY)
    return found.where(own).select(F.col("path").alias("name"), "rule", "line_no")


_DIRECTIVE_ROWS, _DIRECTIVE_WANT = cases.directive_cases()


@expect("name string, vector string, rule string, line_no int", _DIRECTIVE_WANT)
def sxv_directive_cases(spark, sf_dir):
    """Directives in prose with their guards and relations."""
    return each(spark, _DIRECTIVE_ROWS, "name string, text string", lambda n, t: [(n, v, r, k) for v, r, _, _, k, _ in instruction.directives(t)], "name string, vector string, rule string, line_no int")


@expect("body string, shape string", [(b, s) for b, s in cases.COMMENTS if s])
def sxv027_comment_cases(spark, sf_dir):
    return each(spark, [(b,) for b, _ in cases.COMMENTS], "body string", lambda b: [(b, s)] if (s := instruction.comment_shape(b)) else [], "body string, shape string")


@expect("name string, vector string, rule string, severity string, line_no int, col_no int", [(n, *w) for n, _, want in cases.CHARACTERS for w in want])
def sxv014_character_cases(spark, sf_dir):
    """Hidden and look-alike characters (SXV-014, SXV-015) with near misses."""
    rows = [(n, t) for n, t, _ in cases.CHARACTERS]
    return each(spark, rows, "name string, text string", lambda n, t: [(n, v, r, s, a, b) for v, r, s, _, a, b in inspect.character_findings(t)], "name string, vector string, rule string, severity string, line_no int, col_no int")


@expect("name string, vector string, rule string, severity string", [(n, *w) for n, _, _, want in cases.byte_cases() for w in want])
def sxv035_byte_cases(spark, sf_dir):
    """Bytes that are not what their name says, archives behind other data, bytes behind the end (SXV-035 to SXV-037)."""
    rows = [(n, rel, bytearray(raw)) for n, rel, raw, _ in cases.byte_cases()]
    return each(spark, rows, "name string, rel string, raw binary", lambda n, rel, raw: [(n, f.vector, f.rule, f.severity) for f in forensics.byte_findings(rel, bytes(raw))], "name string, vector string, rule string, severity string")


@expect("name string, format string", [(n, f) for n, _, f in cases.format_cases()])
def f22_format_cases(spark, sf_dir):
    return each(spark, [(n, bytearray(raw)) for n, raw, _ in cases.format_cases()], "name string, raw binary", lambda n, raw: [(n, forensics.sniff(bytes(raw)))], "name string, format string")


@expect("path string, rule string, line_no int", cases.SECRET_WANT)
def sxv017_secret_cases(spark, sf_dir):
    """Every credential shape, near misses, and fenced ones."""
    return detect.secret_findings(given(spark, [("p", *r) for r in cases.SECRETS], "pkg_id string, rel string, kind string, text string")).select("path", "rule", "line_no")


@expect("path string, rule string", [("a.js", "obfuscated-script"), ("b.js", "obfuscated-script"), ("c.ts", "minified-script")])
def sxv044_script_cases(spark, sf_dir):
    names = " ".join(f"_0x{k:04x}" for k in range(20))
    rows = [
        ("p", "a.js", "script_javascript", f"x\n{names}\n"), ("p", "b.js", "script_javascript", "\\x41" * 200), ("p", "c.ts", "script_typescript", "a" * 33_000), ("p", "c.min.js", "script_javascript", "a" * 33_000),
        ("p", "d.js", "script_javascript", "a\n" * 20_000), ("p", "e.js", "script_javascript", "_0x1234 " * 40), ("p", "f.py", "script_python", names), ("p", "g.js", "script_javascript", None),
    ]
    return detect.obfuscated_scripts(given(spark, rows, "pkg_id string, rel string, kind string, text string")).where("rule is not null").select("path", "rule")


# -- parsers ---------------------------------------------------------------------------------------------


@expect("rel string, kind string, code string, detail string", [(r, k, *w) for r, k, _, want in cases.DIAGNOSTICS for w in want])
def m1_diagnostic_cases(spark, sf_dir):
    """What each parser reports of files it cannot read, with its bounds."""
    return each(spark, [(r, k, t) for r, k, t, _ in cases.DIAGNOSTICS], "rel string, kind string, text string", lambda r, k, t: [(r, k, *d) for d in parsing.diagnostics_of(r, k, t)], "rel string, kind string, code string, detail string")


@expect("name string, wrong string", [(n, w) for n, _, want in cases.REPORTS for w in want])
def k3_report_check_cases(spark, sf_dir):
    """Report documents that do not hold together (K3)."""
    return each(spark, [(n, json.dumps(d)) for n, d, _ in cases.REPORTS], "name string, doc string", lambda n, d: [(n, w) for w in report.validate(json.loads(d))], "name string, wrong string")


@expect("records long, errors long, oversize long, kind string, n long", [(5, 3, 1, "parse error", 1), (5, 3, 1, "timeout", 2)])
def a15_error_header_cases(spark, sf_dir):
    """Header of a run with errors, and its error kinds."""
    rows = given(spark, [("a", None, False), ("b", "timeout: 5 s", False), ("c", "timeout: /x/y", False), ("d", "parse error: line 3", False), ("e", None, True)], "benchmark_id string, error string, oversize boolean")
    return scoring.error_kinds(rows)


@expect("name string, callee string, n_args int, literal string", [(n, *w) for n, _, want in cases.CALLS for w in want])
def m14_call_cases(spark, sf_dir):
    """Calls of Python texts by their full names."""
    return each(spark, [(n, t) for n, t, _ in cases.CALLS], "name string, text string", lambda n, t: [(n, c, k, v) for _, c, k, v in inspect.python_calls(t)], "name string, callee string, n_args int, literal string")


@expect("name string, line_no int, pipe_place int, argv string", [(n, *w) for n, _, want in cases.COMMANDS for w in want])
def m15_command_cases(spark, sf_dir):
    """Simple commands of shell texts; one that cannot be read gives its error."""

    def one(n: str, t: str) -> list[tuple]:
        try:
            return [(n, c.line, c.place, " ".join(c.argv)) for c in shell_tree.parse(t) if c.argv]
        except shell_tree.ShellError as e:
            return [(n, e.line, None, "error")]

    return each(spark, [(n, t) for n, t, _ in cases.COMMANDS], "name string, text string", one, "name string, line_no int, pipe_place int, argv string")


@expect("rel string, name string, specifier string, pinned boolean", [(rel, *w) for rel, _, want in cases.DEPENDENCIES for w in want])
def m11_dependency_cases(spark, sf_dir):
    """Dependencies of requirements files, pyproject.toml and package.json."""
    return each(spark, [(r, t) for r, t, _ in cases.DEPENDENCIES], "rel string, text string", lambda r, t: [(r, *d) for d in inspect.dependencies(r, t)], "rel string, name string, specifier string, pinned boolean")


@expect("line string, name string, extras string, specifiers string, url string, marker string, pinned boolean", [(x, *(want or (None,) * 6)) for x, want in cases.REQUIREMENTS])
def f15_requirement_cases(spark, sf_dir):
    """Requirements by their grammar; a text that is none gives nulls."""

    def one(line: str) -> list[tuple]:
        r = requirements.parse(line)
        return [(line, *((r.name, ",".join(r.extras), ",".join(a + b for a, b in r.specifiers), r.url, r.marker, r.pinned) if r else (None,) * 6))]

    return each(spark, [(x,) for x, _ in cases.REQUIREMENTS], "line string", one, "line string, name string, extras string, specifiers string, url string, marker string, pinned boolean")


@expect("spec string, pinned boolean, from_source boolean", [("1.2.3", True, False), ("v1.2.3-rc.1", True, False), ("^1.2.3", False, False), ("npm:@a/b@1.0.0", True, False), ("*", False, False), ("github:a/b", False, True), ("git+ssh://x/y.git", False, True), ("a/b#main", False, True), ("file:../x", False, True), ("1.2", False, False)])
def f16_npm_cases(spark, sf_dir):
    specs = ["1.2.3", "v1.2.3-rc.1", "^1.2.3", "npm:@a/b@1.0.0", "*", "github:a/b", "git+ssh://x/y.git", "a/b#main", "file:../x", "1.2"]
    return each(spark, [(x,) for x in specs], "spec string", lambda x: [(x, requirements.npm_pinned(x), requirements.npm_from_source(x))], "spec string, pinned boolean, from_source boolean")


@expect("rel string, gap string", [(r, g) for r, _, gaps in cases.MANIFEST_GAPS for g in gaps])
def m12_manifest_gap_cases(spark, sf_dir):
    """What of a manifest is reported because it is no dependency that can be read."""
    return each(spark, [(r, t) for r, t, _ in cases.MANIFEST_GAPS], "rel string, text string", lambda r, t: [(r, g) for g in requirements.manifest(r, t)[1]], "rel string, gap string")


@expect("v string, quoted string, rejoined string", [("a b/c?d=é", "a%20b/c%3Fd%3D%C3%A9", None), ("HTTP://u@H.example:80/a?b#c", "HTTP%3A//u%40H.example%3A80/a%3Fb%23c", "http://u@h.example:80/a?b#c"), ("x", "x", None), ("ftp://h", "ftp%3A//h", "ftp://h"), ("http://[::1]:8/x", "http%3A//%5B%3A%3A1%5D%3A8/x", "http://[::1]:8/x")])
def f8_url_function_cases(spark, sf_dir):
    """Percent quoting, and addresses taken apart and put together again."""
    vs = ["a b/c?d=é", "HTTP://u@H.example:80/a?b#c", "x", "ftp://h", "http://[::1]:8/x"]
    return given(spark, [(v,) for v in vs], "v string").select("v", texts.quote("v").alias("quoted"), texts.url_unsplit(texts.url_split(F.col("v"))).alias("rejoined"))


@expect("value string, tool string, pattern string, parsed boolean, breadth string", [(v, *w) for v, want in cases.GRANTS for w in want])
def m4_grant_cases(spark, sf_dir):
    """Grants of a manifest line: split, parsed and graded (SXV-003, SXV-004)."""
    return each(spark, [(v,) for v, _ in cases.GRANTS], "value string", lambda v: [(v, *inspect.grant(g)) for g in inspect.split_grants(v)], "value string, tool string, pattern string, parsed boolean, breadth string")


@expect("name string, tool string, pattern string", cases.DENIAL_WANT)
def j6_denial_cases(spark, sf_dir):
    """Grants that no denial covers."""
    g = given(spark, cases.DENIALS, "pkg_id string, rel string, tool string, pattern string, parsed boolean, breadth string, allowed boolean")
    return inspect.effective_grants(g).select(F.col("rel").alias("name"), "tool", "pattern")


@expect("command string, path string, reason string", cases.HOOKS)
def j22_hook_cases(spark, sf_dir):
    """Hook commands: the file they run, or why they name none (SXV-012)."""
    return each(spark, [(c,) for c, _, _ in cases.HOOKS], "command string", lambda c: [(c, *hooks.resolve_hook(c))], "command string, path string, reason string")


@expect("name string, rule string, message string", [(n, *w) for n, _, _, want in cases.HOOK_FILES for w in want])
def sxv012_hook_file_cases(spark, sf_dir):
    """Hook configurations of every type, in places where they count and where they do not, and malformed ones."""
    return each(spark, [(n, r, t) for n, r, t, _ in cases.HOOK_FILES], "name string, rel string, text string", lambda n, r, t: [(n, f[1], f[3]) for f in hooks.hook_findings(r, t)], "name string, rule string, message string")


@expect("text string, server string, package string, pinned boolean", [(t, *w) for t, want in cases.SERVERS for w in want])
def sxv013_server_cases(spark, sf_dir):
    return each(spark, [(t,) for t, _ in cases.SERVERS], "text string", lambda t: [(t, s, p, ok) for s, _, p, ok in inspect.servers_of(t)], "text string, server string, package string, pinned boolean")


@expect("name string, key string, value string, code string", [(n, *w) for n, _, want in cases.FRONT_MATTER for w in want])
def m3_front_matter_cases(spark, sf_dir):
    """Front matter by its node graph, and its error codes (M2, M3, SXV-034)."""

    def one(n: str, t: str) -> list[tuple]:
        values, _, _, codes = markdown.front_matter(t)
        return [(n, k, str(v), None) for k, v in values.items()] + [(n, None, None, c) for c in codes]

    return each(spark, [(n, t) for n, t, _ in cases.FRONT_MATTER], "name string, text string", one, "name string, key string, value string, code string")


@expect("block string, start_line int, end_line int, detail string", cases.DOCUMENT_BLOCKS)
def m5_block_cases(spark, sf_dir):
    """Blocks of one document with every kind of them, tables included (M5, M9)."""
    return each(spark, [(cases.DOCUMENT,)], "text string", lambda t: list(markdown.blocks(t)), "block string, start_line int, end_line int, detail string")


@expect("name string, token string, code string, line_no int, runs boolean", [(n, *w) for n, _, want in cases.BANGS for w in want])
def m7_load_time_cases(spark, sf_dir):
    """Commands that run when a document is loaded, and tokens that only look so (M7, M8, SXV-001, SXV-002)."""
    return each(spark, [(n, t) for n, t, _ in cases.BANGS], "name string, text string", lambda n, t: [(n, k, c, a, r) for k, c, a, _, r in markdown.bang_tokens(t)], "name string, token string, code string, line_no int, runs boolean")


@expect("language string, code string", [("shell", "\n\nls\n\n\n\n\n\nb"), ("python", "\n\n\n\n\nx")])
def m16_code_unit_cases(spark, sf_dir):
    """Fenced code of a document by language, each fence at its line."""
    return each(spark, [("t\n```bash\n$ ls\n```\n```py\nx\n```\n```sh\nb\n```\n```text\nno\n```",)], "text string", lambda t: [(g, c) for g, _, c in markdown.code_units("a.md", t)], "language string, code string")


@expect("text string, body string, line_no int, col_no int", [("a <!-- x --> b", " x ", 1, 3), ("a\n\n<!--\ny\n-->\n", "\ny\n", 3, 1)])
def m6_comment_cases(spark, sf_dir):
    rows = [("a <!-- x --> b",), ("a\n\n<!--\ny\n-->\n",), ("```\n<!-- z -->\n```",), ("none",)]
    return each(spark, rows, "text string", lambda t: [(t, *c) for c in markdown.comments(t)], "text string, body string, line_no int, col_no int")


@expect("name string, code string, severity string, line_no int", [(n, *w) for n, _, want, _ in cases.HTML_BLOCKS for w in want])
def m6_html_block_cases(spark, sf_dir):
    """HTML blocks that hide text or hold active content, and plain ones (M6)."""
    return each(spark, [(n, t) for n, t, _, _ in cases.HTML_BLOCKS], "name string, text string", lambda n, t: [(n, *x) for x in markdown.html_notes(t)], "name string, code string, severity string, line_no int")


@expect("name string, prose string", [(n, p) for n, _, _, want in cases.HTML_BLOCKS for p in want])
def m6_html_prose_cases(spark, sf_dir):
    return each(spark, [(n, t) for n, t, _, _ in cases.HTML_BLOCKS], "name string, text string", lambda n, t: [(n, x) for x, _ in markdown.html_prose(t)], "name string, prose string")


# -- relations -------------------------------------------------------------------------------------------


@expect("source string, target string", [("SKILL.md", "docs/a.md"), ("docs/a.md", "docs/b c.md"), ("docs/b c.md", "SKILL.md"), ("lost.md", "docs/a.md")])
def j2_reference_cases(spark, sf_dir):
    """Links resolved against the folder of their file: escapes, other schemes, anchors and missing files are none."""
    return graph.references(given(spark, cases.LINKED, "pkg_id string, rel string, kind string, text string")).select("source", "target")


@expect("rel string", [("SKILL.md",), ("docs/a.md",), ("docs/b c.md",)])
def j3_reach_cases(spark, sf_dir):
    """Files reached from a manifest over a cycle of links."""
    from .checkpoints import use_shared_folder

    use_shared_folder(spark)
    a = given(spark, cases.LINKED, "pkg_id string, rel string, kind string, text string")
    return graph.reach(graph.references(a).checkpoint(), a.where("kind = 'skill_manifest'")).select("rel")


@expect("name string, side string, axis string, state string", cases.CLAIM_WANT)
def x8_claim_cases(spark, sf_dir):
    """What descriptions claim; one statement outside the grammar voids its source."""
    rows = [(n, "SKILL.md", "skill_manifest", t) for n, t in cases.CLAIMS]
    return report.manifest_claims(given(spark, rows, "pkg_id string, rel string, kind string, text string")).select(F.col("pkg_id").alias("name"), "side", "axis", "state")


@expect("name string, axis string, state string", cases.DECLARED)
def x9_declaration_cases(spark, sf_dir):
    """Axes that the grants of a manifest reach, after its denials; an unparsed grant leaves what is not reached unknown."""
    rows = [("p", n, t, p, ok, None, allowed) for n, listed in cases.DECLARATIONS for t, p, ok, allowed in listed]
    g = given(spark, rows, "pkg_id string, rel string, tool string, pattern string, parsed boolean, breadth string, allowed boolean")
    return correlate.declarations(g).select(F.col("manifest").alias("name"), "axis", "state")


@expect("pkg_id string, axis string, claimed string, declared string, observed string, understated boolean", cases.TRIAD_WANT)
def x10_triad_cases(spark, sf_dir):
    """Claimed, declared and observed capabilities with conflicts and gaps (A8, J7, J23, X9, X10, SXV-033)."""
    manifests = given(spark, [(p, "SKILL.md") for p in ("a", "b", "c", "d")], "pkg_id string, manifest string")
    claims = given(spark, cases.TRIAD_CLAIMS, "pkg_id string, manifest string, side string, axis string, state string")
    seen = given(spark, [("a", "SKILL.md", "network"), ("b", "SKILL.md", "execution")], "pkg_id string, manifest string, axis string")
    gaps = given(spark, [("c", "SKILL.md"), ("d", None)], "pkg_id string, manifest string")
    t = correlate.triads(manifests, claims, seen, gaps)
    under = correlate.understated(t).select("pkg_id", "axis", F.lit(True).alias("_u"))
    return t.join(under, ["pkg_id", "axis"], "left").select("pkg_id", "axis", "claimed", "declared", "observed", F.coalesce("_u", F.lit(False)).alias("understated"))


@expect("name string, source string", [("a", "line"), ("b", "parsed"), ("c", "parsed")])
def j25_dependency_cases(spark, sf_dir):
    """Dependencies found by the parser that the line scan has not seen (equal name and source)."""
    by_line = given(spark, [("p", "r.txt", "a", "https://x/a")], "pkg_id string, rel string, name string, source string")
    parsed = given(spark, [("p", "r.txt", "a", "https://x/a"), ("p", "r.txt", "b", None), ("p", "q.txt", "c", "https://x/a")], "pkg_id string, rel string, name string, source string")
    return inspect.unseen_dependencies(by_line, parsed).select("name", F.col("seen_by").alias("source"))


@expect("specifiers string, canonical string", [("==1.0, ==1.0", "==1"), (">=1.0,<2.0, >= 1.0", "<2,>=1"), ("==1.0.0,==1", "==1"), ("==1.*", "==1.*"), ("~=1.4.2", "~=1.4.2"), ("", "")])
def u7_specifier_cases(spark, sf_dir):
    """Sets of version specifiers, each kept once in a canonical form."""
    rows = ["==1.0, ==1.0", ">=1.0,<2.0, >= 1.0", "==1.0.0,==1", "==1.*", "~=1.4.2", ""]
    return each(spark, [(r,) for r in rows], "specifiers string", lambda s: [(s, inspect.canonical_specifiers(s))], "specifiers string, canonical string")


# -- functions -------------------------------------------------------------------------------------------


@expect("v string, stripped string, folded string, composed string, shown string, unquoted string, words string", cases.TEXT_WANT)
def f1_text_function_cases(spark, sf_dir):
    """strip, casefold, NFC, repr, unquote and shell words."""
    df = given(spark, [(r[0],) for r in cases.TEXT_WANT], "v string")
    v = F.col("v")
    return df.select("v", texts.strip(v).alias("stripped"), texts.casefold(v).alias("folded"), texts.nfc(v).alias("composed"), texts.python_repr(v).alias("shown"), texts.unquote(v).alias("unquoted"), F.array_join(texts.words(v), "|").alias("words"))


@expect("v string, n_lines int", [("a\nb", 2), ("a\r\nb\rc", 3), ("a b\x0bc\x85d", 4), ("", 0), ("x\n", 1)])
def p2_line_boundary_cases(spark, sf_dir):
    return given(spark, [("a\nb",), ("a\r\nb\rc",), ("a b\x0bc\x85d",), ("",), ("x\n",)], "v string").select("v", F.size(texts.split_lines("v")).alias("n_lines"))


@expect("v string, is_public boolean", [("8.8.8.8", True), ("10.0.0.1", False), ("127.0.0.1", False), ("169.254.1.1", False), ("::1", False), ("2001:4860:4860::8888", True), ("::ffff:10.0.0.1", False), ("64:ff9b::7f00:1", False), ("64:ff9b::808:808", True), ("224.0.0.1", False), ("x", None)])
def f14_address_cases(spark, sf_dir):
    vs = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "::1", "2001:4860:4860::8888", "::ffff:10.0.0.1", "64:ff9b::7f00:1", "64:ff9b::808:808", "224.0.0.1", "x"]
    return given(spark, [(v,) for v in vs], "v string").select("v", texts.is_public_address("v").alias("is_public"))


@expect("v string, canonical string", [('{"b":1, "a":[1.0, "é"]}', '{"a":[1.0,"\\u00e9"],"b":1}'), ("[]", "[]"), ("{", None), ('{"a":{"c":null,"b":true}}', '{"a":{"b":true,"c":null}}')])
def p19_canonical_cases(spark, sf_dir):
    """Canonical JSON."""
    return given(spark, [('{"b":1, "a":[1.0, "é"]}',), ("[]",), ("{",), ('{"a":{"c":null,"b":true}}',)], "v string").select("v", texts.canonical_json("v").alias("canonical"))


@expect("path string, text string", [("prompt", "x"), ("tools[0].description", "y"), ("tools[1].messages[0].content", "z")])
def p20_prompt_cases(spark, sf_dir):
    doc = json.dumps({"prompt": "x", "name": "n", "tools": [{"description": "y", "id": "i"}, {"messages": [{"content": "z"}]}]})
    return given(spark, [(doc,), ("{",)], "v string").select(F.explode(texts.prompt_fields("v")).alias("f")).select("f.path", "f.text")


@expect("v string, shown string", [("a\tb", "a\\tb"), ("a\x1b[31m", "a\\x1b[31m"), ("naïve", "naïve"), ("x‮y", "x\\u202ey"), ("back\\slash", "back\\\\slash")])
def p22_shown_name_cases(spark, sf_dir):
    """Names with control characters escaped."""
    return given(spark, [("a\tb",), ("a\x1b[31m",), ("naïve",), ("x‮y",), ("back\\slash",)], "v string").select("v", texts.shown_name("v").alias("shown"))


@expect("line string, shown string, misleads boolean", [(line, bidi.visual_order(line) if want is None else want, m) for line, want, m in cases.BIDI])
def f20_display_order_cases(spark, sf_dir):
    """Order in which lines of both directions are shown."""
    return each(spark, [(x,) for x, _, _ in cases.BIDI], "line string", lambda x: [(x, bidi.visual_order(x), bidi.misleads(x))], "line string, shown string, misleads boolean")


@expect("expression string, value string", cases.STATIC)
def f25_static_value_cases(spark, sf_dir):
    """Texts of Python expressions that are known without running them."""
    return each(spark, [(e,) for e, _ in cases.STATIC], "expression string", lambda e: [(e, engine_python.static_text(e))], "expression string, value string")


@expect("line string, severity string", cases.INSTALLERS)
def f23_installer_cases(spark, sf_dir):
    """A fetch piped to a shell is medium on the line of a well-known installer."""
    return each(spark, [(x,) for x, _ in cases.INSTALLERS], "line string", lambda x: [(x, engine.graded("E04", x))], "line string, severity string")


# -- findings and reports ---------------------------------------------------------------------------------

_FINDING = "pkg_id string, path string, vector string, rule string, severity string, message string, line_no int, col_no int"


@expect("path string, rule string, n long, note string", [("a", "findings-capped", 1, "V: 15 more"), ("a", "r", 25, None), ("b", "r", 25, None), ("c", "findings-capped", 1, "r: 1 more"), ("c", "r", 25, None)])
def w3_cap_cases(spark, sf_dir):
    """Groups of forty, twenty-five and twenty-six findings under the cap; without a vector the rule makes the group."""
    rows = [("p", f, v, "r", "high", f"m{k}", k, None) for f, v, n in (("a", "V", 40), ("b", "V", 25), ("c", "", 26)) for k in range(n)]
    capped = findings.cap(given(spark, rows, _FINDING))
    return capped.groupBy("path", "rule").agg(F.count("*").alias("n"), F.max(F.when(F.col("rule") == "findings-capped", F.col("message"))).alias("note"))


@expect("variant string, rule string, n long", [("", "E61-network", 2), ("", "E60-execution", 2), ("", "findings-capped", 2), ("instruction", "E60-execution", 1), ("instruction", "E61-network", 1), ("instruction", "findings-capped", 1), ("obfuscation", "E60-execution", 2), ("obfuscation", "E61-network", 2), ("obfuscation", "findings-capped", 2)])
def w3b_cap_variant_cases(spark, sf_dir):
    """Groups under the cap by capability, without that split, and by rule and severity."""
    rows = [("p", "a", "SXV-033", r, "medium", "m", k, None) for r in ("E60-execution", "E61-network") for k in range(4)]
    out = None
    for variant in ("", "instruction", "obfuscation"):
        part = findings.cap(given(spark, rows, _FINDING), 2, variant=variant).groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(variant).alias("variant"), "rule", "n")
        out = part if out is None else out.unionByName(part)
    return out


@expect("kind string, id string", [("candidate", "c9"), ("result", "r9")])
def k3_dangling_cases(spark, sf_dir):
    """Links of a report that point nowhere."""
    links = given(spark, [("r1", "c1"), ("r9", "c1"), ("r1", "c9")], "result_id string, candidate_id string")
    return report.dangling(links, given(spark, [("r1",)], "result_id string"), given(spark, [("c1",)], "candidate_id string"))


@expect("pkg_id string, n_results int, report string, error string", [
    ("a", 2, '{"rules":["r1","r2"],"results":[{"ruleId":"r2","level":"critical","uri":"x","startLine":4},{"ruleId":"r1","level":"low","uri":"x"}]}', None), ("b", 3, None, "too many results for one document"),
])
def k1_report_cases(spark, sf_dir):
    """Documents of packages; one with more results than a document may hold."""
    rows = [("a", "x", "V", "r2", "critical", "m", 4, None), ("a", "x", "", "r1", "low", "m", None, None), *(("b", "y", "V", "r", "low", "m", k, None) for k in range(3))]
    return report.package_reports(given(spark, rows, _FINDING), most=2)


@expect("ok boolean, why string", cases.POLICY_WANT)
def x5_policy_cases(spark, sf_dir):
    """Policies that are taken whole or refused whole."""

    def one(doc: str) -> list[tuple]:
        try:
            report.check_policy(json.loads(doc))
        except ValueError as e:
            return [(False, str(e))]
        return [(True, None)]

    return each(spark, [(json.dumps(d),) for d in cases.POLICIES], "doc string", one, "ok boolean, why string")


@expect("entry string, path string, rule string, line_no int, col_no int", cases.ENGINE_WANT)
def s19_engine_report_cases(spark, sf_dir):
    """A report of an outside engine: results mapped to their sources, gaps for everything else."""
    rows = engine_report.decoded(given(spark, cases.ENGINE_REPORTS, "report_id string, document string")).cache()
    targets = given(spark, cases.ENGINE_TARGETS, "report_id string, path string, source string")
    gaps = rows.where("entry = 'gap'").select("entry", "path", "rule", "line_no", "col_no")
    none = F.lit(None).cast("int")
    left = engine_report.unscanned(targets, rows).select(F.lit("gap").alias("entry"), F.col("source").alias("path"), F.lit("engine-analysis-incomplete").alias("rule"), none.alias("line_no"), none.alias("col_no"))
    return engine_report.mapped(rows, targets).select("entry", "path", "rule", "line_no", "col_no").unionByName(gaps).unionByName(left)


@expect("a string, b string, same boolean", [(a, b, s) for a, b, s in cases.EVIDENCE])
def p18_evidence_cases(spark, sf_dir):
    """Evidence that says the same at another place or with other engine keys."""
    return each(spark, [(a, b) for a, b, _ in cases.EVIDENCE], "a string, b string", lambda a, b: [(a, b, engine_report.evidence_digest(a) == engine_report.evidence_digest(b))], "a string, b string, same boolean")


@expect("name string, steps int", cases.TRACE_WANT)
def x4_trace_cases(spark, sf_dir):
    """Traces from source to sink: the number of steps, null for one that cannot be used."""
    return each(spark, cases.traces(), "name string, trace string", lambda n, t: [(n, None if (f := engine_report.code_flow(json.loads(t))) is None else len(f))], "name string, steps int")


@expect("name string, region string", cases.SLICE_WANT)
def p17_slice_cases(spark, sf_dir):
    """Text between two places, null where they are turned round or outside."""
    rows = [(n, *place) for n, place, _ in cases.SLICES]
    from ..operators.anchors import slice_text

    return each(spark, rows, "name string, a int, b int, c int, d int", lambda n, a, b, c, d: [(n, slice_text("one\ntwo é\n\nfour", a, b, c, d))], "name string, region string")


@expect("benchmark_id string, label int, pair_error string", [("a", 1, None), ("b", 0, None), ("c", 1, "labels differ"), ("d", 0, "only in the second run")])
def j16_pair_cases(spark, sf_dir):
    """Rows of two runs: the later one counts, an id of the second only and another label are errors."""
    schema = "benchmark_id string, label int, blocking boolean"
    before, after = given(spark, [("a", 1, False), ("b", 0, True), ("c", 0, False)], schema), given(spark, [("a", 1, True), ("c", 1, False), ("d", 0, False)], schema)
    return scoring.paired(before, after).select("benchmark_id", "label", "pair_error")


@expect("error string, kind string", [("timeout: /a/b took long", "timeout"), ("cannot read /a/b.md: gone", "cannot"), ("broken", "broken"), ("parse error: line 3", "parse error")])
def p15_error_kind_cases(spark, sf_dir):
    rows = [("timeout: /a/b took long",), ("cannot read /a/b.md: gone",), ("broken",), ("parse error: line 3",)]
    return given(spark, rows, "error string").select("error", scoring.error_kind(F.col("error")).alias("kind"))


# -- the review lane ---------------------------------------------------------------------------------------


def _reviewed(spark: SparkSession) -> DataFrame:
    replies = {"good": '{"verdict": "benign", "quote": ""}', "bad": '{"verdict": "malicious", "quote": "do bad"}', "false quote": '{"verdict": "malicious", "quote": "not there"}', "noise": "I think so", "long": "x" * 20_000}

    def reviewer(body: str) -> str | None:
        excerpt = json.loads(body)["excerpt"]
        return next((v for k, v in replies.items() if excerpt.startswith(k)), None)

    return review.judged(given(spark, cases.REVIEWED, "pkg_id string, candidate_id string, vector string, rule string, path string, coverage string, excerpt string"), reviewer)


@expect("candidate_id string, outcome string, quote string, reused boolean", cases.REVIEW_WANT)
def x11_review_cases(spark, sf_dir):
    """Outcomes of candidates by a reviewer with fixed replies: eligibility, replies that cannot be checked, equal requests, the budget."""
    return _reviewed(spark).where("pkg_id = 'p'").select("candidate_id", "outcome", "quote", "reused")


@expect("pkg_id string, outcome string, n long", [("q", "benign", 25), ("q", "budget", 5)])
def x12_budget_cases(spark, sf_dir):
    return _reviewed(spark).where("pkg_id = 'q'").groupBy("pkg_id", "outcome").agg(F.count("*").alias("n"))


@expect("result_id string, effective_severity string, reviewed boolean", [("r1", "low", True), ("r2", "high", False), ("r3", "high", False)])
def x7_applied_review_cases(spark, sf_dir):
    """A benign review demotes its result, once, and only for vectors that may be demoted."""
    results = given(spark, [("p", "r1", "SXV-028", "high"), ("p", "r2", "SXV-029", "high"), ("p", "r3", "SXV-017", "high")], "pkg_id string, result_id string, vector string, severity string")
    links = given(spark, [("p", "r1", "c1"), ("p", "r1", "c4"), ("p", "r2", "c2"), ("p", "r3", "c1")], "pkg_id string, result_id string, candidate_id string")
    return review.applied(results, links, _reviewed(spark)).select("result_id", "effective_severity", "reviewed")


@expect("candidates long, calls long, reused long, over_budget long", [(39, 30, 1, 5)])
def a20_review_usage_cases(spark, sf_dir):
    return review.usage(_reviewed(spark))


@expect("result_id string, outcome string, n_candidates long", [("r1", "benign", 2), ("r2", "malicious", 1)])
def k10_review_audit_cases(spark, sf_dir):
    links = given(spark, [("p", "r1", "c1"), ("p", "r1", "c4"), ("p", "r2", "c2")], "pkg_id string, result_id string, candidate_id string")
    return review.audit(_reviewed(spark), links).select("result_id", "outcome", "n_candidates")


@expect("path string, vector string, rule string, severity string, line_no int", [("a", "SXV-038", "semantic-prompt-injection", "medium", 2), ("b", "SXV-038", "semantic-prompt-injection", "low", None), ("d", "", "review-unparseable", "low", None)])
def sxv038_semantic_cases(spark, sf_dir):
    """Advisory findings of a reviewer on whole files; a quote must stand in the file."""
    said = {"first": '{"verdict": "malicious", "quote": "obey me"}', "second": '{"verdict": "uncertain", "quote": ""}', "third": '{"verdict": "benign", "quote": ""}'}
    files = given(spark, [("p", "a", "first\nobey me"), ("p", "b", "second"), ("p", "c", "third"), ("p", "d", "fourth"), ("p", "e", ""), ("p", "f", None)], "pkg_id string, path string, text string")
    return review.semantic_findings(files, lambda body: next((v for k, v in said.items() if f'"excerpt":"{k}' in body), "?")).select("path", "vector", "rule", "severity", "line_no")


# -- windows over lines --------------------------------------------------------------------------------------

_PROSE = "Known phrases:\n\n- one\n- two\n\nBut not these.\n\nAn end:\n\n\n\n\n- far\n"


def _prose_blocks(spark: SparkSession) -> DataFrame:
    from ..operators import lines

    return lines.blocks(lines.explode_lines(given(spark, [("p", "a.md", _PROSE)], "pkg_id string, rel string, text string")))


@expect("block_no int, intro string", [(2, "Known phrases:"), (5, "An end:")])
def w8_intro_cases(spark, sf_dir):
    from ..operators import lines

    return lines.carried_intros(_prose_blocks(spark)).select("block_no", "intro")


@expect("start_line int, list_end int, n_lists long", [(1, 4, 1)])
def w15_following_list_cases(spark, sf_dir):
    from ..operators import lines

    return lines.following_lists(_prose_blocks(spark)).select("start_line", "list_end", "n_lists")


# -- sources and sinks, each in a folder of its own inside the task ------------------------------------------


@expect("rel string, reason string, size long", cases.TREE_WANT)
def s2_walk_cases(spark, sf_dir):
    """A folder walked: bounds, links, special files, names equal but for case, pruned folders, names with a dot."""

    def one(_: str) -> list[tuple]:
        with tempfile.TemporaryDirectory() as root:
            cases.build_tree(root)
            return [(rel, why, size) for rel, size, why, _ in packages.walk(root)]

    return each(spark, [("",)], "x string", one, "rel string, reason string, size long")


@expect("target string, outcome string", cases.TARGETS)
def s1_target_cases(spark, sf_dir):
    """What a target is, and why others are refused."""

    def one(target: str) -> list[tuple]:
        with tempfile.TemporaryDirectory() as root:
            os.mkdir(os.path.join(root, "folder"))
            os.symlink(os.path.join(root, "folder"), os.path.join(root, "link"))
            for name, data in (("archive.zip", cases._zip()), ("file.md", b"x"), ("other.tar", b"x")):
                with open(os.path.join(root, name), "wb") as f:
                    f.write(data)
            try:
                kind, path = packages.resolve(target if "://" in target else os.path.join(root, target))
                return [(target, kind if kind != "file" or packages.wrap_file(path) else "empty")]
            except ValueError as e:
                return [(target, str(e))]

    return each(spark, [(t,) for t, _ in cases.TARGETS], "target string", one, "target string, outcome string")


@expect("rel string, why string", cases.ROOTS_WANT)
def s8_package_root_cases(spark, sf_dir):
    """Packages under a folder: the topmost ones with a manifest or marker, and a search over its bound."""

    def one(_: str) -> list[tuple]:
        with tempfile.TemporaryDirectory() as root:
            for rel in ("a/SKILL.md", "a/inner/SKILL.md", "b/c/skill.md", "d/plugin.json", "e/readme.md", "node_modules/x/SKILL.md"):
                os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
                open(os.path.join(root, rel), "w").close()
            out = [(os.path.relpath(p, root), None) for p in packages.package_roots(root)]
            try:
                return [*out, *((p, None) for p in packages.package_roots(root, max_dirs=3))]
            except ValueError as e:
                return [*out, (None, str(e))]

    return each(spark, [("",)], "x string", one, "rel string, why string")


@expect("name string, members int, reason string", [(n, k, w) for n, _, k, w in cases.archives()])
def s9_archive_cases(spark, sf_dir):
    """Archives that are taken and those that are refused."""

    def one(name: str, data: bytes) -> list[tuple]:
        members, why = packages.archive_members(bytes(data))
        return [(name, len(members), why)]

    return each(spark, [(n, bytearray(b)) for n, b, _, _ in cases.archives()], "name string, data binary", one, "name string, members int, reason string")


@expect("written string, why string", [('{"a":"\\u00e9","b":1}\n', None), (None, "the report must not be written into the package"), (None, "no file is left behind")])
def k5_report_file_cases(spark, sf_dir):
    """A canonical report written at once, refused inside the package, and no rest of a failed one (K4, K5)."""

    def one(_: str) -> list[tuple]:
        with tempfile.TemporaryDirectory() as root:
            path = os.path.join(root, "out.json")
            records.write_report({"b": 1, "a": "é"}, path)
            with open(path, encoding="ascii") as f:
                out = [(f.read(), None)]
            os.mkdir(os.path.join(root, "pkg"))
            try:
                records.write_report({}, os.path.join(root, "pkg", "r.json"), os.path.join(root, "pkg"))
            except ValueError as e:
                out.append((None, str(e)))
            return [*out, (None, "no file is left behind" if sorted(os.listdir(root)) == ["out.json", "pkg"] else "files are left behind")]

    return each(spark, [("",)], "x string", one, "written string, why string")


@expect("rel string, kind string, role string", cases.KINDS)
def s5_classify_cases(spark, sf_dir):
    """Kinds and roles by name, in the order in which they are tried."""
    from ..operators import classify

    return given(spark, [(r,) for r, _, _ in cases.KINDS], "rel string").select("rel", classify.kind().alias("kind")).withColumn("role", classify.role())
