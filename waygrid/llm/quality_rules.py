"""Quality rules, line first.

Each line of a text is judged on its own: navigation bars, boilerplate, symbol litter,
shouting, one word over and over, long lines without any sentence end, and lines that
repeat an earlier line of the text. Boilerplate phrases and words over and over are
looked for in windows of `window_words` words; a line fails by them if more than half of its
words stand in failing windows, so that a long line isn't lost by one phrase. Failing lines go. A document is rejected if it fails
the base rules (too few words, too many words in repeated 3-word windows) or if the lines
that go hold more than `max_lost_percent` of its characters in words.

Words are runs of anything but ASCII white space; lines end at \\n only. Null and empty
texts have no words and are rejected. Every line and word of long texts is judged. Equal
rows are judged each, by their own text alone. Columns of the input besides doc_id and
text don't matter to the verdict; `clean_documents` carries all of them through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SENTENCE_END = re.compile(r"[.!?…。！？]")
#: Signs between the entries of a navigation line.
BARS = "|•·›→"
#: Fixed phrases of page furniture in the corpus's languages: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "javascript is disabled", "javascript is required", "subscribe to our", "sign up for our",
    "skip to content", "skip to main content", "lorem ipsum", "click here", "read more", "share this page", "share on facebook", "share on twitter",
    "alle rechte vorbehalten", "cookie-richtlinie", "cookie-einstellungen", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen",
    "allgemeine geschäftsbedingungen", "javascript aktivieren", "newsletter abonnieren", "zum inhalt springen", "hier klicken", "klicken sie hier", "weiterlesen", "mehr lesen", "seite teilen", "auf facebook teilen", "auf twitter teilen",
    "tous droits réservés", "politique de cookies", "paramètres des cookies", "accepter les cookies", "accepter tous les cookies", "politique de confidentialité", "conditions d'utilisation",
    "conditions générales d'utilisation", "activer javascript", "abonnez-vous à", "aller au contenu", "cliquez ici", "lire la suite", "partager cette page", "partager sur facebook", "partager sur twitter",
    "todos los derechos reservados", "política de cookies", "configuración de cookies", "aceptar cookies", "aceptar todas las cookies", "política de privacidad", "términos de uso", "condiciones de uso",
    "activar javascript", "suscríbete a", "saltar al contenido", "ir al contenido", "haz clic aquí", "haga clic aquí", "leer más", "compartir esta página", "compartir en facebook", "compartir en twitter",
)


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50
    nav_bars: int = 2  # bars of a navigation line, at least,
    nav_words_per_bar: int = 4  # with so many words for each, at most
    words_per_symbol: int = 4
    shout_words: int = 5
    monotone_words: int = 8
    monotone_ratio: int = 3  # words for each different word, from which a line is monotone
    unended_words: int = 12
    window_words: int = 64


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lost_lines: int
    text: str  # the lines that stay


def failing_window(words: list[str], rules: Rules) -> str | None:
    if len(words) >= rules.monotone_words and len(set(words)) * rules.monotone_ratio <= len(words):
        return "monotone"
    low = " ".join(words).lower()
    return "boilerplate" if any(x in low for x in BOILERPLATE) else None


def failing_rule(line: str, words: list[str], rules: Rules) -> str | None:
    """The first rule that a line with words fails, by its own contents."""
    n, bars = len(words), sum(map(line.count, BARS))
    if bars >= rules.nav_bars and n <= bars * rules.nav_words_per_bar:
        return "navigation"
    if symbols(line) * rules.words_per_symbol >= n:
        return "symbols"
    if n >= rules.shout_words and line == line.upper() != line.lower():
        return "shouting"
    if n >= rules.unended_words and not SENTENCE_END.search(line):
        return "punctuation"
    lost: dict[str, int] = {}
    for i in range(0, n, rules.window_words):
        if rule := failing_window(part := words[i : i + rules.window_words], rules):
            lost[rule] = lost.get(rule, 0) + len(part)
    return max(lost, key=lambda k: lost[k]) if 2 * sum(lost.values()) > n else None


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:]))) == len(words) - 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # keeps codes small: no overflow
    _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def judge(text: str | None, rules: Rules = Rules()) -> Verdict:
    text = text or ""
    lines = text.split("\n")
    all_words: list[str] = []
    seen: set[str] = set()
    kept, n_dup, lost, total = [], 0, 0, 0
    for line in lines:
        words = WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        all_words += words
        chars = sum(map(len, words))
        total += chars
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or failing_rule(line, words, rules):
            lost += chars
        else:
            kept.append(line)
    n = len(all_words)
    n_repeat = repeated_words(all_words)
    failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
    return Verdict(n, total, symbols(text), n_dup, n_repeat, failed, not failed and 100 * lost <= rules.max_lost_percent * total, len(lines) - len(kept), "\n".join(kept))


def quality_digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every document; no shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]

    def run(batches):
        for b in batches:
            found = [judge(t, rules) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([getattr(v, n) for v in found], t) for n, t in zip(names, types)]], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_lines long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, all their columns, the text without its failing lines.
    A column n_chars, if there is one, is set to the new length."""
    names = docs.columns

    def run(batches):
        for b in batches:
            found = [judge(t, rules) for t in b.column("text").to_pylist()]
            keep = pa.array([v.kept for v in found], pa.bool_())
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([v.text for v in found], b.schema.field(at).type)).filter(keep)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
