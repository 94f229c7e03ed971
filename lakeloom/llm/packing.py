"""Packing: token sequences of a fixed window, planned on the histogram of lengths by non-negative least squares.

Each document's ids are cut at every full window; the full windows are sequences of their own, and what is left of
each document (the tail, shorter than a window) is planned by its length alone. Shallow combinations of lengths that
fill a window are enumerated; their repeat counts are fitted to the histogram by non-negative least squares
(multiplicative updates), rounded down, and the lengths that remain are packed greedily, longest first. The plan has
at most a few entries for each of the window-1 lengths, whatever the number of documents, so only the histogram and
the plan pass through the driver. Tails of one length are numbered in salted parts, so that a length which a third of
all rows share is dealt out too.

Defined cases: a null text is an empty one, whose ids are the end id alone; repeated rows are packed each; null ids
are allowed; an empty table gives an empty result; other columns go. Strings of special tokens in a text are text.
"""

from __future__ import annotations

import bisect
import itertools
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.llm.common import columns, lean, materialise, ranges, table

WINDOW, END_ID, SALTS = 4096, 2, 1024
#: Words whose ids a worker remembers, of so many ids each on average; it changes time and memory, no result.
REMEMBER, IDS_A_WORD = 400_000, 16
#: Bytes of text whose ids a worker finds at once (a longer text is taken alone), and new words that the model gets at once.
TEXT_BYTES, WORDS_AT_ONCE = 1 << 23, 10_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by a word-level BPE.

    The tokenizer's own cutting never crosses a blank, so a text's ids are those of its blank-separated chunks in
    turn. Many texts are taken at once: Arrow finds their distinct chunks, and the words of these are numbered, with
    the ids of each word held in one array (up to about `remember` words, and those of the texts in hand); the texts'
    ids are taken from it by place. In chunks of ASCII and Latin-1 letters the words are found here and new ones given
    to the tokenizer's BPE model, many at a time, as the id that ends a word tells; other chunks count as one word each
    and go through the whole tokenizer.
    """

    def __init__(self, file: str, remember: int = REMEMBER):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(file)
        self.whole.encode_special_tokens = True
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        plain = r"\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ"
        self.plain, self.odd = re.compile(f"[{plain}]*").fullmatch, re.compile(f"[^{plain}]").search
        # fixed by the vocabulary file: how it cuts words; blanks are found too
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+| ").findall
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = np.arange(256, dtype="<u4")  # the letter that stands for a byte
        for c in map(chr, range(0xC0, 0x100)):
            self.letters[list(c.encode())] = [ord(x) for x in bytes_of(c)[0][0]]
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known = {" ": 0}  # the numbers of words; the blank between chunks has no ids
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        self.first = np.concatenate([self.first, starts + len(self.ids)])
        self.size = np.concatenate([self.size, ends - starts])
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def _learn(self, words: list[str], odd: list[str]) -> None:
        found = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            line = np.frombuffer(" ".join(words[at : at + WORDS_AT_ONCE]).encode(), np.uint8)
            line = self.letters[line].tobytes().decode("utf-32-le")
            found.append(np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32))
        if words:
            ids = np.concatenate(found)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the vocabulary does not mark the end of each word")
            self._add(words, ids, ends)
        if odd:
            found = [e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
            self._add(odd, np.array([i for ids in found for i in ids], np.uint32), np.cumsum([len(ids) for ids in found]))

    def of(self, texts, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """texts: an Arrow string array, nulls as empty texts. The ids of all, each text's followed by `end`, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.remember or len(self.ids) > IDS_A_WORD * self.remember:
            self._forget()
        chunks = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = chunks.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py()
        odd = []
        if self.odd(joined) is None:
            words = self.cut(joined.lower())
        else:
            words = []
            for c in joined.split(" "):
                if self.plain(c):
                    words += self.cut(c.lower())
                else:
                    words.append(c)
                    odd.append(c)
                words.append(" ")
            words.pop()
        odd = [c for c in odd if c not in self.known]
        self._learn(list(set(words).difference(self.known, odd)), odd)
        # the distinct chunks' ids, and where each chunk's are
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size[number])])
        blanks = np.flatnonzero(number == 0)
        first = upto[np.concatenate([np.zeros(1, np.int64), blanks])]
        length = upto[np.concatenate([blanks, np.full(1, len(words))])] - first
        ids = np.concatenate([self.ids[ranges(self.first[number], self.size[number])], np.array(end, np.uint32)])
        first, length = np.append(first, upto[-1]), np.append(length, len(end))
        # the texts' ids: those of their chunks, and the end as one more chunk
        stops = chunks.offsets.to_numpy()[1:].astype(np.int64)
        order = np.insert(coded.indices.to_numpy().astype(np.int64), stops, len(first) - 1)
        size = length[order]
        total = np.cumsum(size)[stops + np.arange(len(stops))]
        return ids[ranges(first[order], size)], np.diff(total, prepend=0)

    def __call__(self, text: str) -> bytes:
        """Ids of one text, as little-endian 32-bit bytes."""
        import pyarrow as pa

        return self.of(pa.array([text], pa.string()), [])[0].astype("<u4").tobytes()


def blocks(texts):
    """Slices of an Arrow string array, of at most TEXT_BYTES or of one text."""
    import pyarrow.compute as pc

    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TEXT_BYTES, "right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def cut_pieces(batches, file: str, remember: int, window: int, end_id: int):
    """Batches of doc_id and text to batches of PIECES."""
    import gc
    import zlib

    import pyarrow as pa

    on = gc.isenabled()
    gc.disable()  # nothing here makes cycles, and looking for them takes time
    try:
        ids_of = WordIds(file, remember)
        for b in batches:
            out, docs = [], b.column(0).to_pylist()
            for lo, texts in blocks(b.column(1)):
                ids, counts = ids_of.of(texts, [end_id])
                ids, at = memoryview(ids.astype("<u4")).cast("B"), 0
                for i, n in zip(docs[lo:], counts.tolist()):
                    for s in range(0, n, window):
                        m = min(window, n - s)
                        out.append((i, s, m, zlib.crc32(ids[4 * (at + s) : 4 * (at + s + m)]), n))
                    at += n
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names)
    finally:
        if on:
            gc.enable()


def token_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, file: str | None = None, remember: int = REMEMBER) -> DataFrame:
    """One row per piece: full windows and tails, with the checksum of their ids."""
    pieces = partial(cut_pieces, file=file or vocabulary_file(), remember=remember, window=window, end_id=end_id)
    return columns(docs, doc_id="long", text="string").mapInArrow(lean(pieces), PIECES)


def combinations(lengths: list[int], window: int) -> list[dict[int, int]]:
    """Shallow fillings of the window: one length repeated, then another repeated, then one that closes the gap."""
    have, out, seen = set(lengths), [], set()
    for a in lengths:
        for m, k in itertools.product(range(1, min(4, window // a) + 1), range(0, 13)):
            rest = window - m * a
            combo = {a: m}
            if k and rest:
                i = bisect.bisect_right(lengths, rest // k) - 1
                if i < 0:
                    continue
                b = lengths[i]
                combo[b] = combo.get(b, 0) + k
                rest -= k * b
            if rest in have:
                combo[rest] = combo.get(rest, 0) + 1
                rest = 0
            key = tuple(sorted(combo.items()))
            if rest <= 2 and key not in seen:
                seen.add(key)
                out.append(combo)
    return out


def repeat_counts(combos: list[dict[int, int]], counts: dict[int, int], window: int, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares of the histogram by the combinations, by multiplicative updates."""
    col = np.array([j for j, c in enumerate(combos) for _ in c])
    row = np.array([n for c in combos for n in c])
    val = np.array([v for c in combos for v in c.values()], float)
    b = np.zeros(window + 1)
    for n, c in counts.items():
        b[n] = c
    up = np.bincount(col, val * b[row], len(combos))
    x = np.full(len(combos), b.sum() / max(1.0, val.sum()))
    for _ in range(rounds):
        ax = np.bincount(row, val * x[col], window + 1)
        x *= up / np.maximum(np.bincount(col, val * ax[row], len(combos)), 1e-12)
    return x


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple], int]:
    """Entries (length, first rank, rank after the last, first sequence, repeats in a sequence, offset there)."""
    left, used, entries, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0

    def take(combo: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n, m in combo.items():
            entries.append((n, used[n], used[n] + times * m, sequences, m, offset))
            used[n] += times * m
            left[n] -= times * m
            offset += n * m
        sequences += times

    lengths = sorted(counts)
    combos = combinations(lengths, window)
    if combos:
        x = repeat_counts(combos, counts, window)
        for j in np.argsort(-x, kind="stable"):
            times = min([int(x[j]), *(left[n] // m for n, m in combos[j].items())])
            if times > 0:
                take(combos[j], times)
    lengths = [n for n in lengths if left[n]]
    while lengths:
        combo, space, at = {}, window, len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            m = min(space // n, left[n])
            if m:
                combo[n] = m
                space -= m * n
            at = min(at - 1, bisect.bisect_right(lengths, space) - 1)
        take(combo, min(left[n] // m for n, m in combo.items()))
        lengths = [n for n in lengths if left[n]]
    return entries, sequences


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, file: str | None = None, salts: int = SALTS, remember: int = REMEMBER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, window, end_id, file, remember), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    units = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most window * salts rows
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    units = units.withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {int(r["length"]): int(r["n"]) for r in units.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    full = counts.pop(window, 0)
    entries, _ = plan(counts, window)
    entries = [(n, a, b, s + full, m, o) for n, a, b, s, m, o in entries] + [(window, 0, full, 0, 1, 0)]
    plan_df = spark.createDataFrame(entries, "length long, a long, b long, s0 long, m long, o long")
    rank = F.col("rank0") + F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.join(units.drop("n"), ["length", "salt"]).withColumn("rank", rank)
    placed = ranked.join(F.broadcast(plan_df), "length").where("rank >= a and rank < b")  # bounded by the lengths
    turn = F.col("rank") - F.col("a")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("s0") + F.floor(turn / F.col("m"))).cast("long").alias("sequence_id"),
        (F.col("o") + (turn % F.col("m")) * F.col("length")).cast("long").alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
