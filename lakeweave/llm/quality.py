"""Quality rules, line first: bad lines go, then documents that lost too much of their text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import small_batches
from lakeweave.llm.workers import lean

#: fixed values: characters that count as symbols, and marks that separate the entries of a menu
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "·", "•", "→", "/", "::")
#: fixed values: phrases of boilerplate lines in English, German, French and Spanish, lower case
BOILERPLATE = (
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our newsletter",
    "terms of service", "terms of use", "use cookies", "uses cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-richtlinie", "verwendet cookies", "verwenden cookies",
    "datenschutzerklärung", "javascript ist deaktiviert", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "utilise des cookies", "utilisons des cookies",
    "javascript est désactivé", "abonnez-vous à notre newsletter", "conditions d'utilisation", "aller au contenu", "mentions légales",
    "todos los derechos reservados", "aceptar cookies", "aceptar las cookies", "política de privacidad", "utiliza cookies",
    "utilizamos cookies", "javascript está desactivado", "suscríbete a nuestro boletín", "condiciones de uso", "términos de uso", "saltar al contenido",
)
_SPACES = " \t\n\r\x0b\x0c"
#: punctuation and symbols of any script (of the basic plane, so that a bitmap decides)
_MARKS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c))[0] in "PS") + "]")


@dataclass(frozen=True)
class LineRules:
    """A line goes if its share of punctuation and symbols is above ``most_marks``, if ``separator_share`` or more of its
    words are menu separators, if more than ``most_stutter`` of ten or more words equal the word before, or if it has
    a boilerplate phrase and no more than ``boilerplate_words`` words.
    A document goes if its lines lost more than ``most_lost`` of the characters in its words, if it has fewer than
    ``least_words`` words, or if more than ``most_repeated`` of a hundred words are in repeated windows."""

    most_marks: float = 0.2
    separator_share: float = 0.15
    least_separators: int = 3
    most_stutter: float = 0.4
    boilerplate_words: int = 30
    most_lost: float = 0.5
    least_words: int = 10
    most_repeated: int = 20


def line_fails(line: str, rules: LineRules) -> str | None:
    """The name of the first rule that the line fails; None for a good line. Lines without words are good."""
    words = line.split()
    if not words:
        return None
    inked = sum(map(len, words))
    if len(_MARKS.findall(line)) > rules.most_marks * inked and inked >= 10:
        return "punctuation"
    apart = sum(map(words.count, SEPARATORS))
    if apart >= rules.least_separators and apart >= rules.separator_share * len(words):
        return "navigation"
    if len(words) >= 10 and sum(map(eq, words, words[1:])) > rules.most_stutter * len(words):
        return "stutter"
    if len(words) <= rules.boilerplate_words:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    return None


def repeated_words(words: list) -> int:
    """Words in windows of five words that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 5 - max(i, reach)
            reach = i + 5
    return total


def measure(text: str | None, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, clean text)."""
    text = text or ""
    words = text.encode().split()  # bytes.split() knows ASCII white space only
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    twice = 0
    for line in lines:
        if line.strip(_SPACES):
            twice += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    failed = len(words) < rules.least_words or 100 * repeated > rules.most_repeated * len(words)
    good = [line for line in lines if line_fails(line, rules) is None]
    lost = 0
    clean = text
    if len(good) < len(lines):
        clean = "\n".join(good)
        lost = chars - (len(clean) - sum(map(clean.count, _SPACES)))
    kept = not failed and lost <= rules.most_lost * chars
    return len(words), chars, symbols, twice, repeated, failed, kept, lost, clean


_COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("clean_text", pa.string())]
_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}


def judge_lines(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` with its measures, ``base_failed``, ``kept``, ``lost_chars`` and, if asked for, ``clean_text``.

    One pass without a shuffle. Null text has no words and fails. Columns of ``docs`` named like the results are
    replaced; rows that repeat are judged alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    made = _COLUMNS if with_text else _COLUMNS[:-1]
    docs = docs.drop(*[name for name, _ in _COLUMNS])
    at = docs.columns.index("text")
    kept_columns = [i for i, c in enumerate(docs.columns) if with_text or c != "text"]

    def run(batches):
        for batch in batches:
            found = [measure(t, rules) for t in batch.column(at).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept_columns] + [pa.array(columns[i], kind) for i, (_, kind) in enumerate(made)],
                names=[batch.schema.names[i] for i in kept_columns] + [name for name, _ in made],
            )

    out = docs.select(*[docs.columns[i] for i in kept_columns]).select("*", *[F.lit(None).cast(_TYPES[k]).alias(n) for n, k in made]).schema
    return docs.mapInArrow(run, out)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, without their failed lines, in the columns of ``docs``, whatever their names.

    ``n_chars``, where there is one, is counted anew for a document that lost lines; everything else is as it was. One
    pass without a shuffle. Null and empty texts fail; rows that repeat are judged alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    @lean
    def run(batches):
        for batch in batches:
            found = [measure(t, rules) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([f[-1] for f in found], columns[at].type)
            if count_at is not None:
                counts = [len(f[-1]) if f[-2] else n for f, n in zip(found, columns[count_at].to_pylist(), strict=True)]
                columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([f[6] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
