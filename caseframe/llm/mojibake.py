"""Text that was decoded with a wrong character encoding: finding it and restoring the original.

Every reading of a stretch of text (written back to bytes in the encoding it may have been read with, decoded in the one it
may have been written in; twice for text that was garbled twice) is a candidate, the stretch as it stands is one, and where
characters were lost, so is the stretch with each of them unknown. Each candidate is compressed with the zstandard
dictionaries of the languages whose alphabets write it best. Its description length is the smallest size plus the cost of naming its
chain of encodings; the shortest candidate wins. Unless that beats the text as it stands by a margin, the text is left
as it is.

Two things let zstandard judge names of a few letters. Texts are written in a code in which a letter of the language takes
one symbol whatever its case and a mark is set where the class of letters changes (small, capital, accented, digit, sign and
so on); foreign characters take six. So the literal table of a dictionary, which is trained on many words of its language,
knows how often each letter and each change of class occurs. And each candidate is compressed behind the same ballast of
frequent letters, whose size is taken off again: without it zstandard stores short texts as they are.

The dictionaries are trained on the whole collection: first on all stretches that recur, without garbled forms of more frequent
ones, then on all stretches that the first dictionaries find sound. A stretch teaches the language whose dictionary compresses it
best. Only counts reach the driver: how many distinct words a language has and how often each symbol occurs in them
(:func:`tallies`). The samples that zstandard is trained on hold the symbols in these proportions, in any order, since a literal
table knows no order. Every distinct stretch of the whole collection is judged by the last dictionaries.
"""

from __future__ import annotations

import codecs
import math
import random
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.operators.parallel import worker_partitions
from caseframe.operators.skew import lookup_join
from caseframe.session import ensure_checkpoint_dir

LEAST_COUNT = 3  # stretches that recur so often train the first dictionaries
ROUNDS = 2
MARGIN = 10.0
CHAIN_BITS = {True: 6.0, False: 12.0}  # to UTF-8, to another
LOST_BITS = 8.0
DICTIONARY_BYTES = 1024
BALLAST, FINE, CLOSE = 64, 8, 16
SAMPLES, SAMPLE_BYTES, WORDS = 48, 1000, 120  # samples are made of counts: as if each held so many words of a language
PRIOR = 8  # and every so many of them the alphabet and the uses of signs
KEPT = 200_000
# Encodings that text was read with by mistake, and those it may have been written in.
READ = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1253", "cp1250", "iso8859_15"]
WRITTEN = ["utf-8", "cp1252", "cp1250", "iso8859_2", "cp1254", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7", "cp932", "euc_jp", "mac_roman", "cp437", "cp850", "cp852"]
# Letters beyond ASCII of the languages that network records are mostly written in, signs of ordinary text and
# how they are used.
ALPHABETS = {
    "de": "äöüßÄÖÜ", "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ", "es": "áéíñóúüÁÉÍÑÓÚÜ", "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ", "it": "àèéìòùÀÈÉÌÒÙ", "sv": "åäöÅÄÖ", "da": "æøåÆØÅ", "is": "áðéíóúýþæöÁÐÉÍÓÚÝÞÆÖ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "cs": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "hu": "áéíóöőúüűÁÉÍÓÖŐÚÜŰ", "ro": "ăâîșțĂÂÎȘȚ", "tr": "çğıöşüÇĞİÖŞÜ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "uk": "абвгдежзийклмнопрстуфхцчшщьюяєіїґАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЬЮЯЄІЇҐ", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ",
    "ja": "", "en": "",
}
SIGNS = "’‘“”„«»–—…•€£§°º±·©®™¿¡½µ¶ª"
USES = ["¿a? ¡a!", "¿A? ¡A!", "«a» «A»", "“a” “A”", "„a“ ‘a’", "a’a A’A", "don’t o’ab’ea’r c’’a’", "25 °C", "±5", "§ 12", "¶ 3", "½ a", "3 µs", "n° 4 — 2º a", "40 £/a", "a in € a", "a™ a® a©", "a – a — a… a", "5 • a", "A/A"]
COMMON = "abuse access account address and billing block business by cable city client contact customer department desk east for from group hosting house internal line local main network new north not office old on only pool private public region reserved routing see service south static support technical telecom the to unit west with NET-A POOL-B Co. AG Ltd".split()
SCRIPTS = {"ru": "cyrillic", "uk": "cyrillic", "el": "greek", "ja": "japanese"}  # others Latin

_BROKEN = regex.compile(r"[[\p{Cc}\p{Co}\p{Cn}\p{Cs}�]--[\t\r\n]]", regex.V1)
_PARTS = regex.compile(r"(\n| / |; )")
_SUFFIX = regex.compile(r"(?: #[0-9]+|, [0-9]+|-[0-9]+| \([[\x00-\x7f]--[()]]*\))+$", regex.V1)
_ASCII = regex.compile(r"[\x00-\x7f]+")
_RUNS = regex.compile(r"[\x00-\x7f]+|[^\x00-\x7f]+")


# ---- readings -------------------------------------------------------------------------------------------------------


def _gap(error: UnicodeError) -> tuple[bytes, int]:
    """Control characters stand for themselves where a single-byte encoding has a gap."""
    if isinstance(error, UnicodeEncodeError):
        part = error.object[error.start : error.end]
        if all(128 <= ord(ch) < 160 for ch in part):
            return part.encode("latin-1"), error.end
    raise error


codecs.register_error("caseframe.gap", _gap)


def readings(text: str, twice: bool | None = True) -> dict[str, tuple[tuple[str, str], ...]]:
    """Candidate decodings of a stretch and the shortest chain (read as, written in) that leads to each."""
    out: dict[str, tuple[tuple[str, str], ...]] = {}
    seen: dict[bytes, str] = {}
    for read in READ:
        try:
            seen.setdefault(text.encode(read, "caseframe.gap"), read)
        except UnicodeEncodeError:
            continue
    for raw, read in seen.items():
        for written in WRITTEN:
            try:
                got = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if got != text and got not in out and (twice is None or not broken(got) or written == "utf-8"):
                out[got] = ((read, written),)
                if twice and written == "utf-8":
                    for again, chain in readings(got, None).items():
                        if chain[0][1] == "utf-8" and again != text and again not in out:
                            out[again] = ((read, written), *chain)
    return out if twice is None else {c: chain for c, chain in out.items() if not broken(c)}


def broken(text: str) -> bool:
    """With replacement, private or control characters other than line ends."""
    return _BROKEN.search(text) is not None


def _beyond(text: str) -> str:
    return _ASCII.sub("", text)


def bare(part: str) -> str:
    """A stretch without number and bracket at its end."""
    return _SUFFIX.sub("", part)


# ---- the code in which texts are compressed -------------------------------------------------------------------------

# l small, u capital ASCII letter, a and A others, d digit, s space, p ASCII punctuation, r apostrophe, q quotation
# mark, t dash, S sign, j Japanese,
# e any character that the language doesn't know. Symbols: 0 to 93 for characters of the present class, LOST for one that is
# unknown, STRANGE before a letter of another language of the script and where
# scripts meet within a word, from the top the marks of a change of class.
CLASSES = "luaAdsprqtSje"
LOST, STRANGE = 94, 95
MARKS = {pair: 255 - i for i, pair in enumerate((a, b) for a in CLASSES for b in CLASSES if a != b or a in "aAS")}


@lru_cache(100_000)
def kind(ch: str) -> str:
    """The class of a character."""
    o = ord(ch)
    if o < 128:
        return "l" if "a" <= ch <= "z" else "u" if "A" <= ch <= "Z" else "d" if "0" <= ch <= "9" else "p" if o > 32 else "s"
    if ch in SIGNS:
        return "r" if ch == "’" else "q" if ch in "‘“”„«»" else "t" if ch in "–—…" else "S"
    cat, name = unicodedata.category(ch), unicodedata.name(ch, "")
    if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC")):
        return "j"
    return "A" if cat in ("Lu", "Lt") else "a" if cat in ("Ll", "Lo") else "e"


@lru_cache(100_000)
def _ascii(piece: str, start: bool, end: bool) -> bytes:
    """The symbols of a run of ASCII, alike in all languages, with the marks at the ends of a text."""
    out, before = bytearray(), "s" if start else kind(piece[0])
    for ch in piece:
        k, o = kind(ch), ord(ch)
        if k != before:
            out.append(MARKS[before, k])
        out.append((o | 32) - 97 if k in "lu" else o - 48 if k == "d" else o - 33 if k == "p" else 0 if ch == " " else 1 + o % 32)
        before = k
    if end and before != "s":
        out.append(MARKS[before, "s"])
    return bytes(out)


class Text:
    """A text cut into runs of ASCII and of other characters, these with the classes beside them."""

    def __init__(self, text: str, lost: bool = False) -> None:
        runs = _RUNS.findall(text)
        last = len(runs) - 1
        self.lost = lost
        self.runs: list[bytes | tuple[str, str, str]] = []
        for i, r in enumerate(runs):
            if r < "\x80":
                self.runs.append(_ascii(r, i == 0, i == last))
            else:
                self.runs.append((kind(runs[i - 1][-1]) if i else "s", r, kind(runs[i + 1][0]) if i < last else "s"))
        self.languages = languages("".join([r[1] for r in self.runs if isinstance(r, tuple)]))


class Language:
    """The letters of a language as symbols."""

    def __init__(self, name: str) -> None:
        letters = ALPHABETS[name]
        self.name, self.again = name, "S" if name in SCRIPTS else "aAS"  # classes with a mark even after themselves
        self.kept: dict[tuple[str, str, str], bytes] = {}
        self.codes: dict[str, tuple[str, bytes]] = {}
        script = sorted({ch.lower() for n, a in ALPHABETS.items() if SCRIPTS.get(n) == SCRIPTS.get(name) for ch in a})
        for n, a in ALPHABETS.items():
            for ch in a if SCRIPTS.get(n) == SCRIPTS.get(name) else "":
                self.codes[ch] = (kind(ch), bytes([STRANGE] * (ch not in letters) + [script.index(ch.lower())]))
        for i, ch in enumerate(SIGNS):
            self.codes[ch] = (kind(ch), bytes([i]))

    def code(self, ch: str) -> tuple[str, bytes]:
        got = self.codes.get(ch)
        if got is None:
            if self.name == "ja" and kind(ch) == "j" and (raw := ch.encode("euc_jp", "ignore")) and len(raw) == 2 and raw[0] > 160:
                got = ("j", bytes([raw[0] - 161, raw[1] - 161]))
            else:
                o = ord(ch)
                got = ("e", bytes([o >> 16, o >> 11 & 31, o >> 6 & 31, o & 63]))
            if len(self.codes) < 100_000:
                self.codes[ch] = got
        return got

    def strangeness(self, ch: str) -> int:
        """0 for a letter of the language, 1 for one of its script, else 8."""
        k, code = self.code(ch)
        return 8 if k == "e" else int(code[0] == STRANGE)

    def run(self, before: str, text: str, after: str, lost: bool) -> bytes:
        """Symbols of a run of characters beyond ASCII between two classes."""
        out, meets = [], self.name in SCRIPTS
        if meets and before in "lu":
            out.append(bytes([STRANGE]))
        for ch in text:
            if lost and broken(ch):
                out.append(bytes([LOST]))
                continue
            k, body = self.code(ch)
            if k != before or k in self.again:
                out.append(bytes([MARKS[before, k]]))
            out.append(body)
            before = k
        if before != after:
            out.append(bytes([MARKS[before, after]]))
        if meets and after in "lu":
            out.append(bytes([STRANGE]))
        return b"".join(out)

    def write(self, text: Text) -> bytes:
        """Symbols of a text. One that is marked as lost has letters that aren't known for its broken characters."""
        kept, out = self.kept, []
        for r in text.runs:
            if isinstance(r, bytes):
                out.append(r)
                continue
            got = None if text.lost else kept.get(r)
            if got is None:
                got = self.run(*r, text.lost)
                if not text.lost and len(kept) < 200_000:
                    kept[r] = got
            out.append(got)
        return b"".join(out)


LANGUAGES = {n: Language(n) for n in ALPHABETS}
PLAIN = ("en", "de", "fr", "es")  # of texts without a letter beyond ASCII


@lru_cache(100_000)
def _languages(letters: frozenset[str]) -> tuple[str, ...]:
    missing = {n: sum(x.strangeness(ch) for ch in letters) for n, x in LANGUAGES.items()}
    least = min(missing.values())
    return tuple(n for n, m in missing.items() if m == least or n == "en") if least < 8 * len(letters) else PLAIN


@lru_cache(200_000)
def languages(beyond: str) -> tuple[str, ...]:
    """The languages that know most of the letters among the characters beyond ASCII of a text."""
    letters = frozenset(ch for ch in beyond if kind(ch) in "aAj")
    return _languages(letters) if letters else PLAIN


@lru_cache(200_000)
def alien(beyond: str) -> int:
    """How many of the characters no language knows."""
    return sum(all(x.code(ch)[0] == "e" for x in LANGUAGES.values()) for ch in beyond)


# ---- dictionaries ---------------------------------------------------------------------------------------------------


def alphabet_words(name: str) -> list[str]:
    """Words of an alphabet, so that even a small table has seen its letters: among ASCII letters in Latin script, else among
    themselves; small, capitalised and in capitals."""
    if name == "ja":
        return ["".join(map(chr, range(0x3041, 0x3094))), "".join(map(chr, range(0x30A1, 0x30F7)))]
    low = [ch for ch in ALPHABETS[name] if ch == ch.lower()]
    body = "".join(low) if name in SCRIPTS else "".join(ch + "ten" for ch in low)
    return [body, body[:1].upper() + body[1:], body.upper()]


Tally = tuple[int, np.ndarray, list[str]]  # number of words, occurrences of each symbol in them, the words of most stretches
NONE: Tally = (0, np.zeros(256, dtype=np.int64), [])
# The dictionaries that words of a language train: its own and, beyond Latin script, those of the same script.
TEACHES = {n: (n, *(m for m in SCRIPTS if m != n and SCRIPTS[m] == SCRIPTS.get(n))) for n in ALPHABETS}


def symbols_of(words: Iterable[tuple[str, str]]) -> dict[str, tuple[int, np.ndarray]]:
    """Number and symbols by name of distinct (name of a dictionary, word); those of no name are ASCII, alike in all languages."""
    number: Counter[str] = Counter()
    symbols: dict[str, np.ndarray] = {}
    for name, word in words:
        number[name] += 1
        symbols.setdefault(name, np.zeros(256, dtype=np.int64))[:] += np.bincount(np.frombuffer(LANGUAGES[name or "en"].write(Text(word)), dtype=np.uint8), minlength=256)
    return {n: (number[n], x) for n, x in symbols.items()}


def tallies(words: dict[tuple[str, str], int]) -> dict[str, Tally]:
    """Tallies by name of (name of a dictionary, word) and the number of stretches with it."""
    top: dict[str, list[str]] = {}
    for name, word in sorted(words, key=lambda w: (-words[w], w)):
        top.setdefault(name, []).append(word)
    return {n: (*x, top[n][:WORDS]) for n, x in symbols_of(words).items()}


class Packer:
    """A zstandard dictionary of one language."""

    def __init__(self, name: str, own: Tally, common: Tally) -> None:
        """Trained on samples that hold the symbols as often as ``WORDS`` words of the language, some ASCII words of the
        collection and a part of the alphabet do in the mean over all; and the words of most stretches, which become what texts
        are compared with (they are found in every sample, so their literals don't count)."""
        self.name = name
        rng, write = random.Random(name), LANGUAGES[name].write
        prior = b"".join(write(Text(w)) for w in [*alphabet_words(name), *([] if name in SCRIPTS else USES)])
        more = WORDS // 8 if name in SCRIPTS else max(WORDS // 4, WORDS - own[0])
        mean = np.bincount(np.frombuffer(prior, dtype=np.uint8), minlength=256) / PRIOR
        for (number, symbols, _), most in ((own, WORDS), (common, more)):
            mean = mean + symbols * (min(number, most) / max(1, number))
        mean *= min(1.0, SAMPLE_BYTES / mean.sum())
        upto = np.rint(np.arange(SAMPLES + 1)[:, None] * mean).astype(int)
        top, samples = [write(Text(w)) for w in own[2]], []
        for n in np.diff(upto, axis=0):
            loose = np.repeat(np.arange(256), n).tolist()
            rng.shuffle(loose)
            samples.append(bytes(loose) + b"".join(top)[:SAMPLE_BYTES])
        self.raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=32, d=8, level=1).as_bytes()
        frequent = np.argsort(-mean, kind="stable")[:12].tolist()
        self.ballasts = [bytes(rng.choice(frequent) for _ in range(BALLAST)) for _ in range(FINE)]
        self.zip = None

    def ready(self) -> None:
        """Compressors can't be sent; each worker makes its own."""
        p = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(self.raw)
        data.precompute_compress(compression_params=p)
        self.zip = zstandard.ZstdCompressor(dict_data=data, compression_params=p)
        self.empty = [len(self.zip.compress(b)) for b in self.ballasts]

    def bits(self, text: Text, times: int = 1) -> float:
        """Size of a text in bits; the mean over several ballasts is finer than a byte."""
        symbols = LANGUAGES[self.name].write(text)
        return 8 * sum(len(self.zip.compress(b + symbols)) - n for b, n in zip(self.ballasts[:times], self.empty)) / times


class Model:
    """Dictionaries of all languages, trained on sound stretches."""

    def __init__(self, sound: Iterable[str] = (), rounds: int = ROUNDS) -> None:
        """Of stretches in memory; without rounds there are no dictionaries yet (:func:`modelled`)."""
        self.packers: dict[str, Packer] = {}
        for _ in range(rounds):
            words = Counter({("", w): 0 for w in COMMON})
            words.update(x for s in sound for x in self.teaches(s))
            self.learn(tallies(words))
            self.ready()
        self.unready()

    def learn(self, counts: dict[str, Tally]) -> None:
        self.packers = {n: Packer(n, counts.get(n, NONE), counts.get("", NONE)) for n in LANGUAGES}

    def teaches(self, stretch: str) -> set[tuple[str, str]]:
        """(name of a dictionary, word) of a sound stretch: of the language that compresses it best, of all that may have
        written it if there are no dictionaries yet; ASCII words also without a name."""
        text = Text(stretch)
        names, words = text.languages, {w for w in stretch.split(" ") if w}
        if self.packers and len(names) > 1:
            names = (min(names, key=lambda n: self.packers[n].bits(text)),)
        return {(m, w) for n in names for m in TEACHES[n] for w in words} | {("", w) for w in words if w.isascii()}

    def ready(self) -> None:
        for p in self.packers.values():
            p.ready()
        self.kept: dict[str, tuple[bool, str | None]] = {}

    def unready(self) -> None:
        self.__dict__.pop("kept", None)
        for p in self.packers.values():
            p.zip = None

    def length(self, text: Text, times: int = 1) -> float:
        """Description length in bits."""
        return min(self.packers[n].bits(text, times) for n in text.languages)

    def judge(self, part: str) -> tuple[bool, str | None]:
        """(garbled, restored) of a stretch; restored is null where characters were lost."""
        if part.isascii():
            return False, None
        # A number or an ASCII remark at the end says nothing of the encoding; without it stretches recur.
        own = bare(part)
        if len(own) < len(part):
            hit, fixed = self.judge(own)
            return hit, None if fixed is None else fixed + part[len(own) :]
        got = self.kept.get(part)
        if got is None:
            got = self._judge(part)
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[part] = got
        return got

    def _judge(self, part: str) -> tuple[bool, str | None]:
        gain, got = self.gain(part)
        return (True, got) if gain > 0 else (False, None)

    def gain(self, part: str) -> tuple[float, str | None]:
        """By how many bits the best candidate beats the stretch as it stands and the margin, and that candidate.

        A candidate with more characters that no language knows than the stretch has isn't compressed: each takes six symbols.
        Where bytes are too coarse to decide, those that are close are compressed behind several ballasts.
        """
        whole = Text(part)
        most = alien(_beyond(part))
        found: list[tuple[float, float, Text, str | None]] = []
        for cand, chain in readings(part).items():
            if alien(_beyond(cand)) <= most:
                text, cost = Text(cand), sum(CHAIN_BITS[written == "utf-8"] for _, written in chain)
                found.append((self.length(text) + cost, cost, text, cand))
        if broken(part):
            text = Text(part, True)
            found.append((self.length(text) + LOST_BITS, LOST_BITS, text, None))
        if not found:
            return -math.inf, None
        own, best = self.length(whole) - MARGIN, min(found, key=lambda f: f[0])
        if abs(own - best[0]) > CLOSE:
            return own - best[0], best[3]
        own = self.length(whole, FINE) - MARGIN
        fine = [(self.length(text, FINE) + cost, cand) for bits, cost, text, cand in found if bits <= best[0] + CLOSE]
        bits, cand = min(fine, key=lambda f: f[0])
        return own - bits, cand

    def field(self, text: str | None) -> tuple[bool, str | None]:
        """(garbled, restored) of a whole field."""
        if not text or text.isascii():
            return False, None
        pieces = _PARTS.split(text)
        judged = [self.judge(p) for p in pieces]
        if not any(g for g, _ in judged):
            return False, None
        fixed = "".join(r if r is not None else p for (_, r), p in zip(judged, pieces))
        return True, fixed if fixed != text else None


# ---- over tables ----------------------------------------------------------------------------------------------------

SPLIT, SUFFIX = "\n| / |; ", r"((?: #\d+|, \d+|-\d+| \([\x00-\x7f&&[^()]]*\))+)$"


def fields_of(table: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(id, field, text) of the named text columns, each row once; only texts beyond ASCII, since ASCII is never garbled."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])).alias("f")
    rows = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), each).select("id", "f.field", "f.text")
    return rows.filter(F.col("text").rlike("[^\\x00-\\x7f]")).distinct()


def parts_of(fields: DataFrame) -> DataFrame:
    """(id, field, text, pos, part, own): the stretches of each field beyond ASCII, and each without number and bracket at its
    end."""
    parts = fields.select("id", "field", "text", F.posexplode(F.split("text", SPLIT)).alias("pos", "part"))
    return parts.filter(F.col("part").rlike("[^\\x00-\\x7f]")).withColumn("own", F.regexp_replace("part", SUFFIX, ""))


def _judged(stretches: DataFrame, model: Model, garbled: bool) -> DataFrame:
    """(own, restored) of the garbled ones of distinct stretches, or (own, null) of the sound ones."""
    shared = stretches.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(shared.value)
        for batch in batches:
            judged = [model.judge(s) for s in batch.column(0).to_pylist()]
            at = [i for i, (g, _) in enumerate(judged) if g == garbled]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([judged[i][1] for i in at], pa.string())], names=["own", "restored"])

    return stretches.select("own").mapInArrow(run, "own string, restored string")


def _ready(model: Model) -> Model:
    """A model as it came to a worker, made ready once."""
    if not hasattr(model, "kept"):
        model.ready()
    return model


def modelled(sound: DataFrame) -> Model:
    """A model of all distinct stretches (own). The driver gets the tallies: some 250 numbers a language."""
    model, spark = Model(rounds=0), sound.sparkSession
    given = spark.createDataFrame([("", w, 0) for w in COMMON], "name string, word string, n long")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def words(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = _ready(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    rows = [(*x, n) for x, n in Counter(x for s in batch.column(0).slice(at, 1000).to_pylist() for x in model.teaches(s)).items()]
                    yield _batch(rows, {"name": pa.string(), "word": pa.string(), "n": pa.int64()})

        def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = symbols_of((n, w) for batch in batches for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            rows = [(n, k, int(v)) for n, (number, x) in got.items() for k, v in [(-1, number), *enumerate(x)] if v]
            yield _batch(rows, {"name": pa.string(), "symbol": pa.int32(), "n": pa.int64()})

        each = sound.select("own").mapInArrow(words, "name string, word string, n long").unionByName(given).groupBy("name", "word").agg(F.sum("n").alias("n")).checkpoint()
        counts: dict[str, np.ndarray] = {}
        for name, symbol, n in each.select("name", "word").mapInArrow(symbols, "name string, symbol int, n long").groupBy("name", "symbol").agg(F.sum("n")).collect():
            counts.setdefault(name, np.zeros(257, dtype=np.int64))[symbol] = n  # the number of words is the last
        rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "word"))
        top: dict[str, list[str]] = {}
        for name, word in each.withColumn("rank", rank).filter(F.col("rank") <= WORDS).orderBy("name", "rank").select("name", "word").collect():
            top.setdefault(name, []).append(word)
        model.learn({n: (int(x[-1]), x[:-1], top[n]) for n, x in counts.items()})
    return model


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def without_garbled(recurring: DataFrame) -> DataFrame:
    """(own) of the distinct stretches (own, n) that aren't broken and not a garbled form of a more frequent one."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not broken(s) for s in batch.column(0).to_pylist()], pa.bool_()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, n, c) for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in {x for c in readings(s) for x in (c, bare(c))}]
            yield _batch(rows, {"own": pa.string(), "n": pa.int64(), "cand": pa.string()})

    sane = recurring.select("own", "n").mapInArrow(whole, "own string, n long")
    known = recurring.select(F.col("own").alias("cand"), F.col("n").alias("more"))
    less = sane.mapInArrow(read, "own string, n long, cand string").join(known, "cand").filter("more > n").select("own").distinct()
    return sane.select("own").join(less, "own", "left_anti")


def trained(stretches: DataFrame) -> Model:
    """A model of (own, n), the distinct stretches with their counts: of all that recur, then of all that are sound by these."""
    recurring = without_garbled(stretches.filter(F.col("n") >= LEAST_COUNT)).repartition(worker_partitions(stretches)).checkpoint()
    others = _judged(stretches.filter(F.col("n") < LEAST_COUNT), modelled(recurring), False).select("own").checkpoint()
    return modelled(recurring.unionByName(others))


def garbled(table: DataFrame, key: str, names: list[str]) -> DataFrame:
    """id, field, text, restored of every field with at least one garbled stretch; restored is null where none could be restored.
    Null, empty and ASCII texts are sound. Each distinct stretch is judged once."""
    ensure_checkpoint_dir(table.sparkSession)
    parts = parts_of(fields_of(table, key, names))
    stretches = parts.groupBy("own").agg(F.count(F.lit(1)).alias("n")).repartition(worker_partitions(table), "own").checkpoint()
    found = _judged(stretches, trained(stretches), True)
    hits = lookup_join(parts, found, "own", F.col("id"), "inner")
    # The end that was left out of the judgement is put back; the other stretches and their separators stay.
    fixed = hits.select("id", "field", "text", "pos", (F.col("restored").isNotNull()).alias("ok"), F.concat("restored", F.expr("substring(part, length(own) + 1)")).alias("fixed"))
    each = fixed.groupBy("id", "field", "text").agg(F.map_from_entries(F.collect_list(F.struct("pos", "fixed"))).alias("m"), F.max("ok").alias("ok"))
    pieces = F.transform(F.split("text", SPLIT), lambda x, i: F.coalesce(F.try_element_at("m", i), x))
    seps = F.concat(F.regexp_extract_all("text", F.lit(f"({SPLIT})"), F.lit(1)), F.array(F.lit("")))
    return each.select("id", "field", "text", F.when(F.col("ok"), F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), seps.alias("b")), lambda z: F.concat(z["a"], z["b"])), "")).alias("restored"))
