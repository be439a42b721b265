"""Text decoded with the wrong character encoding: n-gram models of clean text, scored chains, restoration."""

from __future__ import annotations

import codecs
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import bounded_batches, durable

#: Buckets of the hashed bigram table: 2**20 counts, a fixed 4 MB whatever the corpus.
BITS = 20
#: A bigram is rare below this share of all counted bigrams (or this count).
RARE_SHARE, RARE_COUNT = 2e-7, 2
#: Sites are hashed to so many groups, and no group counts more than the median one.
GROUPS = 256
#: A word is not learned from if a chain gains so many nats a bigram (the second: and its bytes are valid UTF-8), a
#: field if so large a share of its words is.
LEARN_MARGINS, MOST_IMPROVED = (1.0, 0.5), 0.2
#: The margin for a single letter whose bigrams are not rare.
LONE_MARGIN = 5.0
#: Entries of a cache of tokens, fields read at once, and tokens counted at once.
CACHED, SLICE, COUNTED = 300_000, 512, 20_000
#: The margin in nats per bigram by which a restoration has to be likelier is fitted between these bounds, in these steps, on
#: every word of every clean field, as it is and garbled on purpose.
MARGINS, MARGIN_STEP = (1.5, 4.0), 0.05
#: Clean fields are hashed to so many folds; words of one are scored by what the others hold.
FOLDS = 2
#: Share of rare bigrams a restoration may keep (the second: where its bytes were valid UTF-8), and rare bigrams that make
#: a word garbled beyond restoration.
RARE_LEFT, LOST_BIGRAMS = (0.34, 0.67), 6

# Fixed values: (decoded with, written in).
CHAINS = (
    [(w, "utf-8") for w in ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8_r", "cp850", "cp437", "cp932", "gb18030", "euc_jp", "big5")]
    + [(w, "cp1251") for w in ("latin-1", "cp1252", "koi8_r", "mac_roman")]
    + [(w, "koi8_r") for w in ("cp1251", "latin-1", "cp1252")]
    + [(w, "cp1252") for w in ("cp850", "cp437", "mac_roman", "cp1251", "koi8_r")]
    + [("cp1252", t) for t in ("cp850", "mac_roman", "cp437")]
    + [(w, "gb18030") for w in ("latin-1", "cp1252", "euc_jp", "cp932", "big5")]
    + [(w, "euc_jp") for w in ("latin-1", "cp1252", "gb18030", "cp932")]
    + [(w, "cp932") for w in ("latin-1", "cp1252", "gb18030", "euc_jp")]
)
#: The encodings text may have been read in, each with those it may have been written in.
WRONG = list(dict.fromkeys(wrong for wrong, _ in CHAINS))
_RIGHTS = [[right for wrong, right in CHAINS if wrong == name] for name in WRONG]
_CODE = re.compile(r"<(code|samp)\b[^>]*>.*?</\1\s*>", re.I | re.S)
#: What no right decoding leaves behind: replacement and control characters, private use.
BROKEN = re.compile("[�\u0080-\u009f-]")
_WORD = re.compile("[A-Za-z]*(?:[^\x00-\x7f\u3000-\u3002\uff0c\uff1f\uff01]+[A-Za-z]*)+")
#: Shapes that clean text hardly has: UTF-8 lead and trail bytes as Latin-1, long runs of Latin-1 letters,
#: small letters before accented capitals, symbols inside words, half-width kana.
_TRAIL = "[\u00a0-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
SUSPECT = re.compile(
    f"[ÂÃÅÐÑ]{_TRAIL}|[à-ï]{_TRAIL}{{2}}"
    "|[¡-¿À-ÿ]{4}|[а-я][А-Я]{2}|[РС][\u0401-\u040f\u0451-\u045f\u00a0-\u00bb\u2010-\u2122]"
    "|[A-Za-z][²³¹÷▀-▟√∑∫∂]|[｡-ﾟ]|‚Ä|¬∑|[a-z][À-ÖØ-Þ]| û "
)


def field_text(text: str, markup: bool) -> str:
    """A field as read: code samples left out of markup, entities decoded."""
    if markup and "<code" in text:
        text = _CODE.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    return text


def _codes(text: str) -> np.ndarray:
    """Code points, with blanks, controls and the marks of tags all as a blank: a word's neighbours are few."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((codes < 33) | (codes == 60) | (codes == 62), np.uint32(32), codes)


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams that have a character beyond ASCII."""
    a, b = codes[:-1], codes[1:]
    wide = (a > 127) | (b > 127)
    return _slot(a[wide], b[wide])


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _tokens(text: str) -> set[str]:
    """The distinct stretches between blanks and marks of tags that hold a character beyond ASCII."""
    for mark in "\n\r\t<>":
        text = text.replace(mark, " ")
    return {t for t in text.split(" ") if not t.isascii()}


def _counter(markup: list[bool], model: BigramModel | None):
    """Counts of bigrams of clean fields by group of sites and fold (bucket, grp, fold, n: fields), and with a model every
    word that was counted (bucket -1), once a fold and task or some more.

    With a model, words that a chain makes likelier are left out, and so are fields with many of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        suspects = _cache("suspect shapes")
        improved = {} if model is None else _cache(model.key)
        for batch in batches:
            groups = batch.column(0).to_pylist()
            for column, is_markup in zip(batch.columns[1:], markup):
                for grp, text in zip(groups, column.to_pylist()):
                    if not text or (text.isascii() and "&" not in text):
                        continue
                    text = field_text(text, is_markup)
                    if text.isascii() or BROKEN.search(text):
                        continue
                    tokens = _tokens(text)
                    for t in tokens:
                        if t not in suspects:
                            suspects[t] = bool(SUSPECT.search(f" {t} "))
                    if any(suspects[t] for t in tokens):
                        continue
                    if model is not None:
                        new = [t for t in tokens if t not in improved]
                        if new:
                            improved.update(zip(new, model.improve(new)))
                        kept = {t for t in tokens if not improved[t]}
                        if len(tokens) - len(kept) > MOST_IMPROVED * len(tokens):
                            continue
                        tokens = kept
                    part = grp * FOLDS + _hash(text) % FOLDS
                    held.update((part, t) for t in tokens)
            if len(held) > CACHED:
                total = _added(total, held)
                if model is not None:
                    yield _held_words(held)
                held.clear()
        used, numbers = _added(total, held)
        if model is not None:
            yield _held_words(held)
        yield _counted_rows(used & ((1 << BITS) - 1), used >> BITS, numbers, pa.nulls(len(used), pa.string()))

    return count


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _counted_rows(buckets: np.ndarray, parts: np.ndarray, numbers: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(x.astype(np.int32)) for x in (buckets, parts // FOLDS, parts % FOLDS)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(numbers.astype(np.int64)), words], ["bucket", "grp", "fold", "n", "word"])


def _held_words(held: Counter) -> pa.RecordBatch:
    found = list({(part % FOLDS, u[0]) for part, token in held for u in _words(token)})
    folds = np.array([fold for fold, _ in found], dtype=np.int64)
    return _counted_rows(np.full(len(found), -1), folds, np.zeros(len(found)), pa.array([word for _, word in found], pa.string()))


def _added(total: tuple[np.ndarray, np.ndarray], held: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Part and bucket in one number, and counts, with those of the held tokens added."""
    keys, numbers = [total[0]], [total[1]]
    items = iter(held.items())
    while some := list(islice(items, COUNTED)):
        # each token between blanks: no bigram across two tokens has a character beyond ASCII
        codes = _codes("".join(f" {token} " for (_, token), _ in some))
        item = np.repeat(np.arange(len(some)), [len(token) + 2 for (_, token), _ in some])
        at = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
        parts, times = np.array([part for (part, _), _ in some], dtype=np.int64), np.array([n for _, n in some], dtype=np.int64)
        used, sums = _summed(_slot(codes[at], codes[at + 1]) | (parts[item[at]] << BITS), times[item[at]])
        keys.append(used)
        numbers.append(sums)
    return _summed(np.concatenate(keys), np.concatenate(numbers))


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, place = np.unique(keys, return_inverse=True)
    return used, np.bincount(place, numbers, len(used)).astype(np.int64)


_CACHES: dict[str, dict] = {}


def _cache(name: str) -> dict:
    """A cache that outlives the task in its Python worker, of bounded size and for at most a few names."""
    if len(_CACHES) > 4 and name not in _CACHES:
        _CACHES.clear()
    cache = _CACHES.setdefault(name, {})
    if len(cache) > CACHED:
        cache.clear()
    return cache


def _words(token: str) -> Iterator[tuple[str, str, str]]:
    """Words with their neighbours."""
    for m in _WORD.finditer(token):
        yield m.group(), token[m.start() - 1 : m.start()] or " ", token[m.end() : m.end() + 1] or " "


class BigramModel:
    """Smoothed joint bigram log-probabilities in a table of fixed size, and the validated margin."""

    def __init__(self, counts: np.ndarray, plain: np.ndarray | None = None):
        """Counts, and the same without weights: what is rare is told by those."""
        plain = counts if plain is None else plain
        self.seen = plain >= max(RARE_COUNT, RARE_SHARE * plain.sum())
        self.total = int(counts.sum())
        self.logp = np.log((counts + 0.5) / (self.total + 0.5 * len(counts))).astype(np.float32)
        self.margin = sum(MARGINS) / 2
        self.key = uuid.uuid4().hex

    def verdicts(self, words: list[tuple[str, str, str]]) -> list[tuple[float, str | None, bool, float, int]]:
        """For each (word, left, right) the likeliest restoration: its gain in nats per bigram of the word, itself, whether it was
        valid UTF-8; and the share of rare bigrams of the word as it is, and their number.

        A restoration must be without many rare bigrams. All words and candidates are scored in one pass.
        """
        if not words:
            return []
        texts: list[str] = []
        starts, flags, finals = [], [], []
        for word, left, right in words:
            starts.append(len(texts))
            texts.append(left + word + right)
            flags.append(False)
            finals.append(None)
            for final, utf8 in candidates(word):
                texts.append(left + final + right)
                flags.append(utf8)
                finals.append(final)
        codes = _codes("".join(texts))
        a, b = codes[:-1], codes[1:]
        segment = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.flatnonzero(((a > 127) | (b > 127)) & (segment[:-1] == segment[1:]))
        slots, segment = _slot(a[at], b[at]), segment[at]
        counts = np.bincount(segment, minlength=len(texts))
        sums = np.bincount(segment, self.logp[slots], len(texts))
        rare = np.bincount(segment, ~self.seen[slots], len(texts)) / np.maximum(counts, 1)
        out = []
        for k, first in enumerate(starts):
            end = starts[k + 1] if k + 1 < len(starts) else len(texts)
            own, best, chosen = counts[first], 0.0, -1
            if own:
                for i in range(first + 1, end):
                    gain = (sums[i] - sums[first]) / own
                    # bytes that happen to be valid UTF-8 are strong evidence by themselves, so more unseen bigrams may remain
                    if gain > best and rare[i] <= RARE_LEFT[flags[i]]:
                        best, chosen = float(gain), i
            out.append((best, finals[chosen] if chosen >= 0 else None, chosen >= 0 and flags[chosen], float(rare[first]), int(own)))
        return out

    def improve(self, tokens: list[str]) -> list[bool]:
        """Whether a chain makes a word of a token so much likelier that nothing should be learned from it.

        A single letter proves nothing, unless its bytes are valid UTF-8.
        """
        words = [(k, *u) for k, token in enumerate(tokens) for u in _words(token)]
        out = [False] * len(tokens)
        for (k, word, _, _), (gain, _, utf8, _, _) in zip(words, self.verdicts([u[1:] for u in words])):
            out[k] = out[k] or (gain >= LEARN_MARGINS[utf8] and (utf8 or len(word) > 1))
        return out


def _control_bytes(error: UnicodeError):
    """Bytes that a code page leaves free are read as control characters: give them back."""
    lost = error.object[error.start : error.end]
    if all("\x80" <= c <= "\x9f" for c in lost):
        return lost.encode("latin-1"), error.end
    raise error


codecs.register_error("orbweave-c1", _control_bytes)


class _Readable(dict):
    """By character, the encodings of WRONG that have it, as bits."""

    def __missing__(self, char: str) -> int:
        bits = 0
        for k, name in enumerate(WRONG):
            try:
                char.encode(name, "orbweave-c1")
                bits |= 1 << k
            except (UnicodeError, ValueError):
                pass
        if len(self) > CACHED:
            self.clear()
        self[char] = bits
        return bits


_READABLE = _Readable()


def _decodings(word: str, tried: set[str], utf8_only: bool = False) -> Iterator[tuple[str, bool]]:
    bits = (1 << len(WRONG)) - 1
    for char in word:
        if char > "\x7f":
            bits &= _READABLE[char]
    for k, name in enumerate(WRONG):
        if not bits >> k & 1:
            continue
        raw = word.encode(name, "orbweave-c1")
        for right in _RIGHTS[k]:
            if utf8_only and right != "utf-8":
                continue
            try:
                decoded = raw.decode(right)
            except (UnicodeError, ValueError):
                continue
            if decoded not in tried and not BROKEN.search(decoded):
                tried.add(decoded)
                yield decoded, right == "utf-8"


def candidates(word: str) -> Iterator[tuple[str, bool]]:
    """What a word may have been, and whether its bytes were valid UTF-8: every chain, and UTF-8 read wrongly once more."""
    tried = {word}
    for decoded, utf8 in _decodings(word, tried):
        yield decoded, utf8
        if not decoded.isascii():
            for final, _ in _decodings(decoded, tried, utf8_only=True):
                yield final, utf8


def _labelled(words: list[str]) -> list[tuple[str, str, str]]:
    """(chain, garbled, original) of clean words: each as it is (chain empty) and, where it can be, through the chain its hash names."""
    out = []
    for word in words:
        out.append(("", word, word))
        wrong, right = CHAINS[_hash(word) % len(CHAINS)]
        try:
            bad = word.encode(right).decode(wrong)
        except (UnicodeError, ValueError):
            continue
        if bad != word and not BROKEN.search(bad):
            out.append((f"{wrong}<-{right}", bad, word))
    return out


def _half(word: str) -> int:
    return _hash(word) >> 32 & 1


def _grid() -> np.ndarray:
    return np.arange(MARGINS[0], MARGINS[1] + MARGIN_STEP / 5, MARGIN_STEP)


def _gains(models: list[BigramModel]):
    """(garbled, half, cell, n): how many margins of the grid a word's gain reaches, of clean words and of garbled ones, of
    which only those count whose very original comes back."""

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for fold, words in _by_fold(batches):
            labelled = _labelled(words)
            judged = models[fold].verdicts([(bad, " ", " ") for _, bad, _ in labelled])
            reached = [v[0] if not chain or v[1] == word else 0.0 for (chain, _, word), v in zip(labelled, judged)]
            cells = np.searchsorted(_grid(), reached, side="right").tolist()
            totals.update((int(bool(chain)), _half(word), cell) for (chain, _, word), cell in zip(labelled, cells))
        columns = [pa.array([k[i] for k in totals], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(totals.values(), pa.int64())], ["garbled", "half", "cell", "n"])

    return gains


def _by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            folds, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for fold in set(folds):
                yield fold, [w for f, w in zip(folds, words) if f == fold]


def fit_margin(clean: np.ndarray, garbled: np.ndarray) -> float:
    """The margin with the fewest wrong decisions on clean words and on the same words garbled by a known chain.

    Given are how many words reach so many margins of the grid. A garbled word counts as right if its very original
    comes back. Of equally good margins the middle one is taken.
    """
    if not garbled.sum():
        return sum(MARGINS) / 2
    found, kept = (1 - np.cumsum(n)[:-1] / n.sum() for n in (clean, garbled))  # reach the first, the second ... margin
    wrong = found + 1 - kept
    best = _grid()[np.isclose(wrong, wrong.min())]
    return float(best[len(best) // 2])


def _groups(rows: DataFrame, site: str | None):
    """Rows of one site are in one group; without sites there is one group."""
    return F.pmod(F.xxhash64(F.col(site)) if site else F.lit(0), F.lit(GROUPS)).cast("int").alias("grp")


class Trained(NamedTuple):
    """The model of all clean fields; for each fold one of the others, with the words (fold, word) it is tried on; the margins
    that either half of the words gives."""

    model: BigramModel
    folds: list[BigramModel]
    words: DataFrame
    margins: list[float]


def train(rows: DataFrame, fields: dict[str, bool], site: str | None = None) -> Trained:
    """Count bigrams over every clean field of all rows, twice, and fit the margin on every word of them.

    No group of sites counts more than the median one, so what one site holds in plenty is not common. The second
    count leaves out what a chain makes likelier under the first. Words are scored by the counts of the folds that
    do not hold their field. Collected are a table of at most 2**20 rows and the numbers of words by margin.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    source = rows.select(_groups(rows, site), *fields)
    model = None
    for _ in range(2):
        schema = "bucket int, grp int, fold int, n bigint, word string"
        counted = durable(source.mapInArrow(_counter(list(fields.values()), model), schema), "bigram-counts")
        bigrams = counted.filter("bucket >= 0")
        sizes = {r.grp: r.n for r in bigrams.groupBy("grp").agg(F.sum("n").alias("n")).collect()}  # at most GROUPS rows
        cap = float(np.median(list(sizes.values()) or [0]))
        weights = F.create_map(*(F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, cap / n)))) if sizes else F.create_map(F.lit(0), F.lit(1.0))
        numbers = {"n": F.col("n") * weights[F.col("grp")], "plain": F.col("n").cast("double")}
        sums = [F.sum(F.when(F.col("fold") == f, x).otherwise(0.0)).alias(f"{name}{f}") for f in range(FOLDS) for name, x in numbers.items()]
        held = bigrams.groupBy("bucket").agg(*sums).toArrow()
        at = held.column("bucket").to_numpy()
        parts = {name: np.zeros((FOLDS, 1 << BITS)) for name in numbers}
        for name, by_fold in parts.items():
            for f in range(FOLDS):
                by_fold[f, at] = held.column(f"{name}{f}").to_numpy()
        model = BigramModel(*(x.sum(axis=0) for x in parts.values()))
    folds = [BigramModel(*(np.delete(x, f, axis=0).sum(axis=0) for x in parts.values())) for f in range(FOLDS)]
    # as many tasks as the session wants: words are few bytes but much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = counted.filter("bucket < 0").select("fold", "word").repartition(tasks, "fold", "word").distinct()
    reached = np.zeros((2, 2, len(_grid()) + 1), dtype=np.int64)
    cells = words.mapInArrow(_gains(folds), "garbled int, half int, cell int, n bigint").groupBy("garbled", "half", "cell").agg(F.sum("n").alias("n"))
    for r in cells.collect():  # at most four times the grid
        reached[r.garbled, r.half, r.cell] = r.n
    model.margin = fit_margin(*reached.sum(axis=1))
    return Trained(model, folds, words, [fit_margin(*reached[:, half]) for half in range(2)])


def judge(model: BigramModel, tokens: list[str]) -> list[tuple[bool, bool, dict[str, str]]]:
    """For each token whether it has a garbled word, whether one without restoration, and the restorations."""
    words = [(k, *u) for k, token in enumerate(tokens) for u in _words(token)]
    found, lost, fixes = [False] * len(tokens), [False] * len(tokens), [{} for _ in tokens]
    for (k, word, _, _), (gain, text, utf8, rare, own) in zip(words, model.verdicts([u[1:] for u in words])):
        # a lone letter that is not rare may just be common on few sites only
        least = model.margin if utf8 or len(word) > 1 or rare else LONE_MARGIN
        if text is not None and gain >= least:
            found[k], fixes[k][word] = True, text
        elif rare == 1 and own >= LOST_BIGRAMS:
            found[k] = lost[k] = True
    return list(zip(found, lost, fixes))


def _finder(model: BigramModel, fields: dict[str, bool], restore: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                yield find_in(whole.slice(at, SLICE))

    def find_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _cache(f"judged {model.key}")
        read: list[tuple[int, str, str, bool, bool, set[str]]] = []
        ids = batch.column(0).to_pylist()
        for k, (name, markup) in enumerate(fields.items(), 1):
            for doc, text in zip(ids, batch.column(k).to_pylist()):
                if not text or (text.isascii() and "&" not in text):
                    continue
                plain = field_text(text, markup)
                if not plain.isascii():
                    broken = bool(BROKEN.search(plain))
                    read.append((doc, name, text, markup, broken, _tokens(plain) if restore or not broken else set()))
        new = list({t for *_, tokens in read for t in tokens if t not in known})
        known.update(zip(new, judge(model, new)))
        docs, names, texts, complete = [], [], [], []
        for doc, name, text, markup, broken, tokens in read:
            verdicts = [known[t] for t in tokens if known[t][0]]
            if broken or verdicts:
                docs.append(doc)
                names.append(name)
                complete.append(not broken and not any(lost for _, lost, _ in verdicts))
                texts.append(replaced(text, {w: x for v in verdicts for w, x in v[2].items()}, markup) if restore else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(complete, pa.bool_())],
            ["doc", "field_name", "restored", "complete"],
        )

    return find


_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")


def _unfolded(raw: str) -> tuple[str, list[int]]:
    """A text with its entities decoded, and where in it each character begins (and the end)."""
    parts, at, begins = [], 0, []
    for m in _ENTITY.finditer(raw):
        text = unescape(m.group())
        if text == m.group():
            continue
        begins += range(at, m.start())
        begins += [m.start()] * len(text)
        parts += [raw[at : m.start()], text]
        at = m.end()
    begins += range(at, len(raw) + 1)
    return "".join([*parts, raw[at:]]), begins


def replaced(text: str, fixes: dict[str, str], markup: bool) -> str:
    """The text with garbled words replaced, character by character the same elsewhere: code samples and all other
    entities stay as they are, and what is put into markup is escaped."""
    out = []
    at = 0
    for m in [*(_CODE.finditer(text) if markup else ()), None]:
        raw = text[at : len(text) if m is None else m.start()]
        plain, begins = _unfolded(raw) if "&" in raw else (raw, range(len(raw) + 1))
        done = 0
        for w in _WORD.finditer(plain):
            fix = fixes.get(w.group())
            if fix is not None:
                out += [raw[done : begins[w.start()]], escape(fix, quote=False) if markup else fix]
                done = begins[w.end()]
        out.append(raw[done:])
        if m is not None:
            out.append(m.group())
            at = m.end()
    return "".join(out)


def garbled_fields(
    rows: DataFrame, fields: dict[str, bool] | None = None, doc: str = "id", restore: bool = False, site: str = "catalog_id"
) -> DataFrame:
    """(doc, field_name, restored, complete): fields with any stretch that was decoded wrongly.

    `fields` maps column names to whether they hold markup. Bigram models are trained in two rounds on all clean
    fields (the first leaves out fields with broken characters or suspect shapes, the second also words that a
    chain makes likelier), sites in groups that count at most as the median one (column `site`, if `rows` has
    it); the margin is fitted on all words of those fields. Every word is run through every encode-decode chain, once more through UTF-8 read wrongly;
    the likeliest result counts if it gains the validated margin. Replacement or control characters and private use are sure signs that need no score; they and words made of rare
    bigrams only are garbled without restoration (`complete` false). Code samples are left alone; entities
    are read as the characters they stand for. Null, empty and pure ASCII fields are never reported; rows
    with null `doc` are left out; repeated rows are reported each; an empty table gives an empty result.
    """
    fields = fields or {"title": False, "html": True}
    bounded_batches(rows.sparkSession)
    model = train(rows, fields, site if site in rows.columns else None).model
    source = rows.select(F.col(doc).cast("bigint").alias("doc"), *fields).filter("doc is not null")
    return source.mapInArrow(
        _finder(model, fields, restore), "doc bigint, field_name string, restored string, complete boolean"
    ).withColumnRenamed("doc", doc)


def _rates(folds: list[BigramModel], margins: list[float]):
    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for fold, words in _by_fold(batches):
            for half in range(2):
                model = folds[fold]
                model.margin = margins[1 - half]
                labelled = _labelled([w for w in words if _half(w) == half])
                for (chain, _, word), (found, _, fixes) in zip(labelled, judge(model, [bad for _, bad, _ in labelled])):
                    totals[chain or "clean", "words"] += 1
                    totals[chain or "clean", "found"] += found
                    totals[chain or "clean", "restored"] += found and word in fixes.values()
        chains = sorted({chain for chain, _ in totals})
        numbers = [pa.array([int(totals[chain, c]) for chain in chains], pa.int64()) for c in ("words", "found", "restored")]
        yield pa.RecordBatch.from_arrays([pa.array(chains, pa.string()), *numbers], ["chain", "words", "found", "restored"])

    return rates


def chain_rates(rows: DataFrame, fields: dict[str, bool] | None = None, site: str = "catalog_id") -> DataFrame:
    """(chain, words, found, restored): the method on all words of clean fields, as they are (chain `clean`: found ones are wrong)
    and garbled on purpose. Each is judged by counts of the folds that do not hold its field, with the margin that the other
    half of the words gives; one that several folds hold counts in each. One row a chain; none without fields."""
    fields = fields or {"title": False, "html": True}
    trained = train(rows, fields, site if site in rows.columns else None)
    found = trained.words.mapInArrow(_rates(trained.folds, trained.margins), "chain string, words bigint, found bigint, restored bigint")
    return found.groupBy("chain").agg(*(F.sum(c).alias(c) for c in ("words", "found", "restored")))
