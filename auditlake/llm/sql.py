"""DuckDB SQL of the text queries that SQL can express on whole tables.

Problem 1: the visual form by SQL string functions, character by character and
composed by the engine's own normalisation.  The other problems need parsers,
tokenizers, models or approximate matching; they are tested against brute
force, round trips and whole parsers (``tests/llm``).
"""

from __future__ import annotations

import unicodedata

from .visual_form import LOOKALIKES, SAME_SIGNS

_ALIKE = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v)} | SAME_SIGNS
# Characters beside which a joiner changes what is drawn, and characters that show nothing (joiners apart), as RE2 classes.
_JOINING = r"[\x{0600}-\x{08FF}\x{0900}-\x{0DFF}\x{1800}-\x{18AF}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
_UNSEEN = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"
)


def _maps() -> tuple[dict[str, str], dict[str, str]]:
    """Characters with an image of one character, and those with a longer one: width, blanks and letters drawn alike, with their accents."""
    single, longer = {}, {}
    for cp in (*range(0xA0, 0x2E80), *range(0x3000, 0x3400), *range(0xA640, 0xA6A0), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)):
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Cf") or cp in (0x3164, 0xFFA0):
            continue
        parts = []
        for x in unicodedata.normalize("NFD", c):
            tag = unicodedata.decomposition(x).partition(" ")[0]
            wide = tag in ("<wide>", "<narrow>") or tag == "<compat>" and 0xFB00 <= ord(x) <= 0xFB06
            parts += [" " if unicodedata.category(y) == "Zs" else _ALIKE.get(y, y) for y in (unicodedata.normalize("NFKD", x) if wide else x)]
        image = unicodedata.normalize("NFC", "".join(parts))
        if image != unicodedata.normalize("NFC", c):
            (single if len(image) == 1 else longer)[c] = image
    return single, longer


def _form(text: str) -> str:
    single, longer = _maps()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(regexp_replace({text}, '({_JOINING})\u200c({_JOINING})', '\\1\ue00c\\2', 'g'), '({_JOINING})\u200d({_JOINING})', '\\1\ue00d\\2', 'g')"
    # neighbours that overlap need a second round
    out = f"regexp_replace(regexp_replace({out}, '({_JOINING})\u200c({_JOINING})', '\\1\ue00c\\2', 'g'), '({_JOINING})\u200d({_JOINING})', '\\1\ue00d\\2', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '[\u200c\u200d]', '', 'g'), '{_UNSEEN}', '', 'g')"
    out = f"nfc_normalize({out})"
    for c, image in longer.items():
        out = f"replace({out}, {quote(c)}, {quote(image)})"
    out = f"translate({out}, {quote(''.join(single))}, {quote(''.join(single.values()))})"
    return f"translate(nfc_normalize({out}), '\ue00c\ue00d', '\u200c\u200d')"


_KEYS = f"keys AS (SELECT DISTINCT artifact_id AS id, {_form('text')} AS form, text FROM artifacts WHERE text IS NOT NULL)"
_PAIRS = f"WITH {_KEYS}, t AS (SELECT form, text, min(id) AS first, count(*) AS n FROM keys GROUP BY ALL)"

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"WITH {_KEYS} SELECT DISTINCT a.id AS artifact_id_a, b.id AS artifact_id_b FROM keys a JOIN keys b ON a.form = b.form AND a.text <> b.text AND a.id < b.id",
    "p1_classes": f"WITH {_KEYS}, c AS (SELECT form, min(id) AS class_id, count(*) AS rows_in_class, count(DISTINCT text) AS texts_in_class FROM keys GROUP BY 1) SELECT id AS artifact_id, class_id, rows_in_class::BIGINT AS rows_in_class, texts_in_class FROM keys JOIN c USING (form)",
    "p1_links": f"{_PAIRS} SELECT a.first AS artifact_id_a, b.first AS artifact_id_b, a.n AS rows_a, b.n AS rows_b FROM t a JOIN t b ON a.form = b.form AND a.first < b.first",
    "p1_forms": f"WITH {_KEYS} SELECT id AS artifact_id, form AS text_form, form <> text AS changed FROM keys UNION ALL SELECT DISTINCT artifact_id, NULL, false FROM artifacts WHERE text IS NULL",
}
