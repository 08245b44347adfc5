"""Line-first cleaning: judge each line, drop failing lines, reject documents that lose too much text.

A line (text between newlines) with at least one word fails when any rule holds:

* punctuation: fewer than `short_line` words and no closing punctuation at its end;
* navigation: three or more words that are only separators, and more than one word in five is;
* boilerplate: fewer than `boiler_words` words and one of BOILERPLATE in it (ASCII case ignored);
* symbols: over a tenth of its word bytes are in `#*$%&|<>`;
* capitals: five or more words and over 60 % of its ASCII letters are capitals.

The cleaned text is the lines of the text that do not fail, blank ones too, joined by newlines again. A document is kept
when its base counts pass and its cleaned text holds at least half of its words' code points.
A null or empty text has no word, all counts 0, "" as cleaned text, and fails. Rows are judged one by one, so repeated rows and ties
need no rule; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, text_blocks
from .wordhash import covered, per_row, repeats, span_hashes, windows_of, words_of

SYMBOLS = "#*$%&|<>"
CLOSERS = ".!?:;)]\"'"
SEPARATORS = ("|", "»", "›", "•", "·", "/", "-")
#: Phrases of site text in the corpus' four languages: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "enable javascript", "subscribe to our", "sign up for our", "click here", "read more", "skip to content",
    "share on facebook", "follow us on",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "javascript aktivieren", "newsletter abonnieren",
    "hier klicken", "weiterlesen", "zum inhalt springen", "auf facebook teilen", "folgen sie uns",
    "tous droits réservés", "politique de confidentialité", "conditions générales", "accepter les cookies", "activer javascript", "abonnez-vous",
    "cliquez ici", "lire la suite", "aller au contenu", "partager sur facebook", "suivez-nous sur",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "política de cookies", "aceptar cookies", "habilitar javascript",
    "suscríbete a", "haz clic aquí", "leer más", "saltar al contenido", "compartir en facebook", "síguenos en",
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, kept_chars long, cleaned string"
)
#: The result columns without the text.
DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_chars")


def _phrases(data: np.ndarray) -> list[int]:
    """Where a boilerplate phrase begins."""
    text, found = data.tobytes().lower(), []
    for phrase in map(str.encode, BOILERPLATE):
        at = text.find(phrase)
        while at >= 0:
            found.append(at)
            at = text.find(phrase, at + 1)
    return found


def _flags(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL, _CLOSER = _flags(SYMBOLS), _flags(CLOSERS)
_UPPER, _LETTER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # the byte begins a code point


def _left(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the bytes that stay without the lines [start, stop) of rows; a stop is behind the line's newline."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[stops] -= 1
    left = np.cumsum(edges[:-1], dtype=np.int8) == 0
    # Where a row's last line went, the newline before it goes too.
    tails = rows[(stops == offsets[rows + 1]) & (data[stops - 1] != 10)]
    places = np.flatnonzero(left)
    a, b = np.searchsorted(places, offsets[tails]), np.searchsorted(places, offsets[tails + 1])
    left[places[b[b > a] - 1]] = False
    return left


def judge(data: np.ndarray, offsets: np.ndarray, short_line: int = 8, boiler_words: int = 25, min_kept: float = 0.5) -> dict[str, np.ndarray | pa.Array]:
    """The result columns for the rows of one block of UTF-8 text."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    n_words = np.diff(words.first)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)

    begin, hashes = windows_of(words, 5)
    row = words.row_of()
    again = covered(len(words.starts), begin[repeats(row[begin], hashes) > 1], 5)

    # Lines, those of a row following each other; a row's end ends its last line.
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    starts, ends = cuts[:-1], cuts[1:]
    ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10) if len(data) else 0)
    first = np.searchsorted(words.starts, cuts)
    lined = np.diff(first) > 0
    starts, ends, stops, count, last = starts[lined], ends[lined], cuts[1:][lined], np.diff(first)[lined], (first[1:] - 1)[lined]
    line_row = row[last]
    line_first = np.searchsorted(line_row, np.arange(n + 1))
    same = repeats(line_row, line_hash := span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends))
    n_dup = np.zeros(n, np.int64)
    if (same > 1).any():
        rows, dup = line_row[same > 1], line_hash[same > 1]
        pairs = np.unique(np.stack([rows.astype(np.uint64), dup]), axis=1)[0].astype(np.int64)
        n_dup = np.bincount(rows, minlength=n) - np.bincount(pairs, minlength=n)

    bounds = np.stack([starts, ends], 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds], axis=1)[:, 0]
    chars = in_word & _HEAD[data]
    line_bytes, symbols = total(in_word), total(_SYMBOL[data])
    upper, letters = total(_UPPER[data]), total(_LETTER[data])
    width = words.ends - words.starts
    lone = np.zeros(len(width), bool)
    for s in map(str.encode, SEPARATORS):
        lone |= (width == len(s)) & np.all([data[np.minimum(words.starts + k, len(data) - 1)] == b for k, b in enumerate(s)], axis=0) if len(width) else False
    word_line = np.cumsum(np.concatenate([[0], lone]), dtype=np.int64)
    seps = word_line[last + 1] - word_line[last + 1 - count]
    closed = _CLOSER[data[words.ends[last] - 1]]
    boiler = np.zeros(len(starts), bool)
    if len(starts):
        boiler[np.searchsorted(starts, np.array(_phrases(data), np.int64), "right") - 1] = True
    bad = (count < short_line) & ~closed
    bad |= (seps >= 3) & (5 * seps > count)
    bad |= boiler & (count < boiler_words)
    bad |= 10 * symbols > line_bytes
    bad |= (count >= 5) & (10 * upper > 6 * letters)

    word_chars = per_row(chars, offsets)
    n_repeat = per_row(again, words.first)
    left = _left(data, offsets, starts[bad], stops[bad], line_row[bad])
    cleaned = np.concatenate([[0], np.cumsum(left, dtype=np.int64)])[offsets].astype(np.int32), data[left].tobytes()
    kept_chars = per_row(chars & left, offsets)
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": per_row(_SYMBOL[data], offsets), "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & (kept_chars >= min_kept * word_chars),
        "n_lines": np.diff(line_first), "n_bad_lines": per_row(bad, line_first), "kept_chars": kept_chars,
        "cleaned": pa.Array.from_buffers(pa.string(), n, [None, *map(pa.py_buffer, cleaned)]),
    }


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_line: int = 8, boiler_words: int = 25, min_kept: float = 0.5) -> DataFrame:
    """One row per input row: base counts, base_failed, kept, how many lines and code points the rules leave, and the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in text_blocks(batch):
                got = judge(data, offsets, short_line, boiler_words, min_kept)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(v if isinstance(v, pa.Array) else pa.array(v) for v in got.values())], ["doc_id", *got])

    return id_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
