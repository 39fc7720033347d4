"""Keyword index: dictionaries, scanning for all entries at all offsets, hits, previews and staleness.

The dictionary is compiled once per worker: literals into an Aho-Corasick automaton, small patterns into one regular
expression each. Objects are scanned in Arrow batches, so the scan is one pass without a shuffle and its cost doesn't grow
with the number of literals. The dictionary is the only thing that is broadcast; ``MAX_WORDS`` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.operators.parallel import spread

MAX_WORDS = 1_000_000
DETAILED = 1 << 30
# How words are encoded, the least number of bytes of an entry, the most repeats of a pattern's part.
ENCODINGS = {"utf-8": "UTF-8", "utf-16": "UTF-16LE"}
LEAST_BYTES = 3
MOST_REPEATS = 100


def pattern(small: str) -> str:
    """A regular expression of the small pattern language: ``.`` (any character), classes, \\d \\w \\s \\xNN, and the repeats
    ``? * + {l,u}``, which stop at 100. Brackets and bars are ordinary characters. ``?`` is none or one."""
    out, i = [], 0
    while i < len(small):
        ch = small[i]
        if ch == "\\" and i + 1 < len(small):
            n = 4 if small[i + 1] == "x" else 2
            piece = small[i : i + n]
            out.append(piece if piece[1] in "dwsx" else regex.escape(piece[1]))
            i += n
        elif ch == "[" and (close := small.find("]", i + 2)) > 0:
            out.append(small[i : close + 1])
            i = close + 1
        elif ch in "*+?":
            out.append({"*": f"{{0,{MOST_REPEATS}}}", "+": f"{{1,{MOST_REPEATS}}}", "?": "{0,1}"}[ch] if out else regex.escape(ch))
            i += 1
        elif ch == "{" and (m := regex.match(r"\{(\d*),?(\d*)\}", small[i:])) and out:
            low = int(m.group(1) or 0)
            high = int(m.group(2)) if m.group(2) else (MOST_REPEATS if "," in m.group() else low)
            out.append(f"{{{min(low, MOST_REPEATS)},{min(high, MOST_REPEATS)}}}")
            i += m.end()
        else:
            out.append("." if ch == "." else regex.escape(ch))
            i += 1
    return "".join(out)


def _encoded(word: str, kind: str) -> list[bytes]:
    """The byte forms of an entry in binary content."""
    if kind == "word":
        forms = dict.fromkeys(word.lower().encode(c.lower().replace("utf-16le", "utf-16-le")) for c in ENCODINGS.values())
        return [f for f in forms if len(f) >= LEAST_BYTES]
    try:
        return [word.encode("latin-1")]
    except UnicodeEncodeError:
        return []


class Matcher:
    """entries: (id, word, kind) with kind word (any letter case), literal, regex.

    With ``binary``, texts are bytes, each as the character of its number. A word is looked for in every encoding of
    ``ENCODINGS`` that gives it ``LEAST_BYTES`` (only ASCII letters have two cases there), literals and patterns as Latin-1;
    those with other characters can't occur.
    """

    def __init__(self, entries: list[tuple[int, str, str]], binary: bool = False) -> None:
        self.exact, self.folded, self.patterns, self.binary = {}, {}, [], binary
        if binary:
            entries = [(i, b.decode("latin-1"), k) for i, w, k in entries for b in _encoded(w, k)]
        for i, w, kind in entries:
            if not w:
                continue
            if kind == "regex":
                self.patterns.append((i, regex.compile(pattern(w), regex.S)))
            else:
                (self.folded if kind == "word" else self.exact).setdefault(self._lower(w) if kind == "word" else w, []).append(i)
        self.automata = [(self._automaton(self.exact), False), (self._automaton(self.folded), True)]

    def _lower(self, text: str) -> str:
        if self.binary:
            return text.encode("latin-1").lower().decode("latin-1")
        lower = text.lower()
        # a few letters change their length in lower case
        return lower if len(lower) == len(text) else "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)

    @staticmethod
    def _automaton(words: dict[str, list[int]]):  # noqa: ANN205
        if not words:
            return None
        a = ahocorasick.Automaton()
        for w, ids in words.items():
            a.add_word(w, (len(w), ids))
        a.make_automaton()
        return a

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(offset, id, length) of every entry at every offset, overlapping ones too. A pattern gives its longest match at an
        offset."""
        lower = self._lower(text)
        for a, folded in self.automata:
            if a is not None:
                for end, (n, ids) in a.iter(lower if folded else text):
                    for i in ids:
                        yield end - n + 1, i, n
        for i, p in self.patterns:
            for m in p.finditer(text, overlapped=True):
                if m.end() > m.start():
                    yield m.start(), i, m.end() - m.start()


def entries(dictionary: DataFrame) -> list[tuple[int, str, str]]:
    """(id, word, kind) of a dictionary with word_id, word (text), word_type, of ``MAX_WORDS`` words at most."""
    rows = dictionary.filter(F.col("word").isNotNull() & F.col("word_id").isNotNull()).select("word_id", "word", "word_type").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"the dictionary holds more than {MAX_WORDS} words; scan in parts")
    return [(r[0], r[1], r[2]) for r in rows]


def scan(objects: DataFrame, dictionary: DataFrame, key: str = "inode_id", content: str = "content") -> DataFrame:
    """(key, word_id, offset, length) of all hits in all objects. A text is scanned by characters; binary content by bytes, with
    words in all encodings, offsets and lengths in bytes."""
    binary = dict(objects.dtypes)[content] == "binary"
    shared = objects.sparkSession.sparkContext.broadcast(entries(dictionary))
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(shared.value, binary))
        for batch in batches:
            keys, words, offsets, lengths = [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for at, w, n in made[0].hits((raw.decode("latin-1") if binary else raw) if raw else ""):
                    keys.append(i)
                    words.append(w)
                    offsets.append(at)
                    lengths.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(words, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())], names=[key, "word_id", "offset", "length"])

    kind = objects.schema[key].dataType.simpleString()
    return spread(objects.select(key, content)).mapInArrow(run, f"`{key}` {kind}, word_id long, offset long, length int")


def unique(hits: DataFrame, key: str = "inode_id") -> DataFrame:
    """The first hit of each word in each object; words whose id has the bit for detailed scans keep all hits."""
    plain = hits.filter(F.col("word_id").bitwiseAND(DETAILED) == 0)
    first = plain.groupBy(key, "word_id").agg(F.min(F.struct("offset", "length")).alias("m")).select(key, "word_id", "m.offset", "m.length")
    return first.unionByName(hits.filter(F.col("word_id").bitwiseAND(DETAILED) != 0).select(key, "word_id", "offset", "length"))


def expanded(dictionary: DataFrame) -> DataFrame:
    """(word_id, encoding, entry) in every encoding; words in lower case; entries of under three bytes are left out."""
    word = F.when(F.col("word_type") == "word", F.lower("word")).otherwise(F.col("word"))
    forms = F.array(*[F.struct(F.lit(n).alias("encoding"), F.encode(word, c).alias("entry")) for n, c in ENCODINGS.items()])
    rows = dictionary.filter(F.col("word").isNotNull()).select("word_id", F.explode(forms).alias("f")).select("word_id", "f.encoding", "f.entry")
    return rows.filter(F.octet_length("entry") >= LEAST_BYTES)


def stale(objects: DataFrame, version: str, dictionary: DataFrame, key: str = "inode_id") -> DataFrame:
    """Objects whose index version, without the bit for detailed scans, is below the dictionary's, which is its largest id."""
    top = dictionary.agg(F.max("word_id")).first()[0]
    plain = F.coalesce(F.col(version), F.lit(0)).bitwiseAND(DETAILED - 1)
    return objects.filter(plain < F.lit(top)).select(key, version)


def listed(hits: DataFrame, start: int, end: int) -> DataFrame:
    """Hits of an offset range; order them by offset when shown."""
    return hits.filter(F.col("offset").between(start, end))


def with_words(dictionary: DataFrame, words: list[str], word_type: str = "word", word_class: str = "English") -> DataFrame:
    """The dictionary with words that it lacked, under ids after its last."""
    spark = dictionary.sparkSession
    new = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string").join(dictionary.select("word").distinct(), "word", "left_anti").orderBy("word").collect()
    top = dictionary.agg(F.max("word_id")).first()[0] or 0
    rows = [(top + 1 + i, r[0], word_type, word_class) for i, r in enumerate(new)]
    return dictionary.select("word_id", "word", "word_type", "class").unionByName(spark.createDataFrame(rows, "word_id long, word string, word_type string, class string"))


def keyword_column(table: DataFrame, hits: DataFrame, dictionary: DataFrame, key: str = "inode_id") -> DataFrame:
    """Rows of an object table with one hit each, the first one, and its word."""
    first = hits.filter(F.col("word_id").isNotNull()).groupBy(key).agg(F.min(F.struct("offset", "word_id")).alias("m")).select(key, F.col("m.word_id").alias("word_id"), F.col("m.offset").alias("offset"))
    return table.join(first, key).join(dictionary.groupBy("word_id").agg(F.min("word").alias("word")), "word_id")
