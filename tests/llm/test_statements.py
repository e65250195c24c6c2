"""Local grammars of Python and JSON against the whole parsers."""

import ast
import json
import random

from auditlake.llm import statement_grammar

PYTHON = '''import os
@wrap
@other(1)
def f(a, b="x"):
    """Doc with ( and \\""""
    return {a: [b, f'{a!r}']}  # note (
if os:
    x = 1
# between
elif f:
    y = \'\'\'(

\'\'\'
else:
    pass
z = 1 + \\
    2
try:
    pass
finally:
    pass
'''
DOCUMENT = '{"a": [1, -2.5e3, true, null, {"b": "x\\u00e9 \\" y"}, []],\n "c": {}}\n'


def wrong(f, text):
    try:
        f(text)
    except (ValueError, SyntaxError):
        return True
    return False


def test_statements_and_tokens_by_any_chunks_against_the_parsers():
    """Texts cut anywhere, with brackets and quotes lost or doubled, for chunks of any size."""
    rng = random.Random(6)
    for text, check, parse in ((PYTHON, statement_grammar.python_error, ast.parse), (DOCUMENT, statement_grammar.json_error, json.loads)):
        assert not wrong(parse, text)
        for _ in range(700):
            a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            t = rng.choice([text[:a], text[:a] + text[b:], text[:a] + rng.choice("([{}])'\"\n,:") + text[a:], text])
            for size in (1 << 16, 7, 1):
                assert (check(t, size) is not None) is wrong(parse, t), t


def test_depth_and_length_are_not_bounded():
    assert statement_grammar.json_error("[" * 100_000 + "]" * 100_000) is None and statement_grammar.json_error("9" * 10_000) is None
    assert statement_grammar.python_error("x = f'{a['b']}'\n") is None and statement_grammar.python_error("x = (\n" + "1,\n" * 50_000 + ")\n") is None
    for text in ("", "nan", "NaN", "[1,]", '{"a" 1}', "01", "1 2", '"\t"', "﻿1", "tru", "{1: 2}", '{"a": }'):
        assert statement_grammar.json_error(text) is not None


def test_summaries_combine_associatively():
    text = "a = [(\n)\n]\nb = '''\n(\n'''\n}\nc = {\n"
    a, b, c = (statement_grammar.Stretch(statement_grammar.scan_python, text, x, y) for x, y in ((0, 7), (7, 20), (20, len(text))))
    one, two = ((a + b) + c).summary(""), (a + (b + c)).summary("")
    assert all(getattr(one, k) == getattr(two, k) for k in one.__slots__)
