"""Phrase collocation mining with Toivonen's algorithm.

1. A sample of the documents proposes words and phrases, at a threshold below the real one.
2. One pass over all documents counts exactly every proposal and its negative border: all words, and
   each phrase whose parts, without its first and without its last word, were proposed.
3. A border phrase that turns out frequent is a failure of the sample: phrases built on it were not
   counted. Expansion passes count just these, one pass a length, until nothing frequent is left
   whose extensions were not counted. What the sample holds thus only moves work between passes.

The sets of proposals and of frequent parts are probed through bounded Bloom filters (`bloom`). A false
hit makes a pass count a phrase more than it need; whether a pass counts a phrase depends on the
phrase alone, so each count is whole, and no phrase is counted by two passes.

Scale: a task counts the phrases of a chunk of texts by integer names (exact, no hash decides) and
sends them packed, one compressed row per chunk and bucket; a bucket is merged by one task, and their
number follows the bytes of text. A frequent phrase is one entry a chunk. Look-ups of a common
word's count go through `shared.join_hot`, and the report's ranks are cut within shards first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import bloom
from flowlens.llm.bloom import Stretches, chain, contains, encoded, laid
from flowlens.llm.shared import join_hot, width
from flowlens.operators.lineage import cut, release

MIN_COUNT, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
#: One document of SAMPLE_PART is in the sample; a phrase is proposed when it occurs SAMPLE_COUNT times there.
SAMPLE_PART, SAMPLE_COUNT = 8, 2
CHUNK_BYTES, BUCKET_BYTES, MAX_PARTITIONS = 8 << 20, 8 << 20, 1 << 15
#: Candidates of a language that one task ranks.
SHARD_ROWS = 1 << 18
#: Bytes that end a piece, and those that end a word (fixed by the definition of words).
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\v\f\r", b".,;:!?\n\v\f\r \t"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_PIECE, _WORD = _table(PIECE_ENDS), _table(WORD_ENDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Chunk:
    """Words of several texts: integer names of words and languages, what piece each is in, and their hashes."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        end = _WORD[raw]
        edge = np.flatnonzero(end[1:] != end[:-1]) + 1
        edge = np.concatenate([[0], edge]) if len(end) and not end[0] else edge
        low, high = edge[::2], edge[1::2]
        # A word opens a piece when a byte that ends pieces stands before it, after the word before.
        stops = np.flatnonzero(_PIECE[raw])
        self.piece = np.searchsorted(stops, low)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        text = np.searchsorted(ends, low)
        offsets = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[~end].tobytes())])
        coded = words.dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        by_text = pa.array(langs, pa.binary()).dictionary_encode()
        self.langs, self.lang = by_text.dictionary, by_text.indices.to_numpy().astype(np.int64)[text]
        self.word_hash = Stretches(self.words).whole()
        self.lang_hash = Stretches(self.langs).whole()

    def hashes(self, n: int) -> list[np.ndarray]:
        """Hash of the phrase of 1 to `n` words from each word on (of no meaning where it leaves the piece)."""
        own = self.word_hash[self.word]
        out = [chain(self.lang_hash[self.lang], own)]
        for k in range(1, n):
            out.append(chain(out[-1][: max(0, len(own) - k)], own[k:]))
        return out

    def inside(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        size = max(0, len(self.word) - n + 1)
        return self.piece[:size] == self.piece[n - 1 :]

    def count(self, at: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct phrases of n words that begin at `at`: language, words, count."""
        many = max(1, len(self.words))
        name, parts = self.lang[at], []
        for k in range(n):
            both, name, count = np.unique(name * many + self.word[at + k], return_inverse=True, return_counts=True)
            before, word = both // many, both % many
            parts = [p[before] for p in parts] + [word] if k else [word]
            lang = lang[before] if k else before
        return lang, parts, count


def key_hashes(n: int):
    """Hashes of a batch of (lang, phrase) rows whose phrases have n words; the same as `Chunk.hashes`."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        langs, phrases = encoded(batch.column("lang")), encoded(batch.column("phrase"))
        words = Stretches([w for p in phrases for w in p.split(b" ")]).whole().reshape(-1, n)
        return reduce(chain, words.T, Stretches(langs).whole())

    return keys


def _pack(lang: pa.Array, phrase: pa.Array, level: np.ndarray, count: np.ndarray) -> bytes:
    """Entries as bytes: their number and size, then, compressed, counts, lengths, numbers of words and the strings."""
    sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.uint32).tobytes() for x in (lang, phrase)]
    body = b"".join([count.astype(np.int64).tobytes(), *sizes, level.astype(np.uint8).tobytes(), *(laid(x) for x in (lang, phrase))])
    return np.array([len(lang), len(body)], np.int64).tobytes() + pa.compress(body, "zstd", asbytes=True)


def _strings(sizes: np.ndarray, body: memoryview) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def _unpack(blob: bytes) -> pa.Table:
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    body = memoryview(pa.decompress(blob[16:], size, "zstd", asbytes=True))
    count = np.frombuffer(body, np.int64, n)
    lang_size, phrase_size = (np.frombuffer(body, np.uint32, n, 8 * n + 4 * n * k) for k in (0, 1))
    level = np.frombuffer(body, np.uint8, n, 16 * n)
    at, middle = 17 * n, 17 * n + int(lang_size.sum(dtype=np.int64))
    return pa.table(
        {"lang": _strings(lang_size, body[at:middle]), "phrase": _strings(phrase_size, body[middle:]), "words": level, "count": count}
    )


def _entries(chunk: Chunk, chosen: list[tuple[int, np.ndarray]], n_buckets: int, totals: bool) -> Iterator[tuple[int, bytes]]:
    """Packed counts per bucket of the phrases of each chosen length that begin at the chosen words."""
    langs, phrases, levels, counts, buckets = [], [], [], [], []
    for n, at in chosen:
        lang, parts, count = chunk.count(at, n)
        h = reduce(chain, [chunk.word_hash[p] for p in parts], chunk.lang_hash[lang])
        words = [chunk.words.take(pa.array(p)) for p in parts]
        langs.append(chunk.langs.take(pa.array(lang)))
        phrases.append(words[0] if n == 1 else pc.binary_join_element_wise(*words, b" "))
        levels.append(np.full(len(count), n))
        counts.append(count)
        buckets.append(h % np.uint64(n_buckets))
    if totals:  # the words of each language, as a phrase of no words
        lang, count = np.unique(chunk.lang, return_counts=True)
        langs.append(chunk.langs.take(pa.array(lang)))
        phrases.append(pa.array([b""] * len(lang), pa.binary()))
        levels.append(np.zeros(len(lang), np.int64))
        counts.append(count)
        buckets.append(chunk.lang_hash[lang] % np.uint64(n_buckets))
    lang, phrase = pa.concat_arrays(langs), pa.concat_arrays(phrases)
    level, count, bucket = np.concatenate(levels), np.concatenate(counts), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    lang, phrase, level, count, bucket = lang.take(pa.array(order)), phrase.take(pa.array(order)), level[order], count[order], bucket[order]
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(bucket)]]), strict=True):
        if b > a:
            yield int(bucket[a]), _pack(lang.slice(a, b - a), phrase.slice(a, b - a), level[a:b], count[a:b])


def _counted(chunk: Chunk, h: list[np.ndarray], proposed: list[np.ndarray]) -> list[np.ndarray]:
    """By length from 1 on, the words from which the full pass counts a phrase: both of its parts were proposed."""
    out = [np.ones(len(chunk.word), bool)]
    for n in range(2, len(proposed) + 2):
        before, part = out[-1], np.zeros(len(out[-1]), bool)
        part[before] = contains(proposed[n - 2], h[n - 2][: len(before)][before])
        out.append(chunk.inside(n) & part[:-1] & part[1:] if len(part) else part)
    return out


def _sample_pass(n: int):
    return lambda chunk: [(k, np.flatnonzero(chunk.inside(k))) for k in range(1, n + 1)]


def _full_pass(proposed):
    def choose(chunk: Chunk) -> list[tuple[int, np.ndarray]]:
        sets = proposed.value
        return [(n, np.flatnonzero(x)) for n, x in enumerate(_counted(chunk, chunk.hashes(len(sets)), sets), 1)]

    return choose


def _expansion_pass(proposed, frequent, n: int):
    """Phrases of n words whose parts are frequent and that the full pass did not count."""

    def choose(chunk: Chunk) -> list[tuple[int, np.ndarray]]:
        h = chunk.hashes(n - 1)
        fits, before = chunk.inside(n), chunk.inside(n - 1)
        part = np.zeros(len(before), bool)
        part[before] = contains(frequent.value, h[n - 2][before])
        done = _counted(chunk, h, proposed.value[: n - 1])[n - 1]
        return [(n, np.flatnonzero(fits & part[:-1] & part[1:] & ~done) if len(part) else np.zeros(0, np.int64))]

    return choose


def _map_side(choose, n_buckets: int, totals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            chunk = Chunk(texts, langs)
            rows = list(_entries(chunk, choose(chunk), n_buckets, totals)) if len(chunk.word) else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        texts, langs, size = [], [], 0
        for batch in batches:
            for text, lang in zip(encoded(batch.column("text")), encoded(batch.column("lang")), strict=True):
                texts.append(text)
                langs.append(lang)
                size += len(text) + 1
                if size >= CHUNK_BYTES:
                    yield close()
                    texts, langs, size = [], [], 0
        if texts:
            yield close()

    return run


def _merge(min_count: int):
    """Counts of whole buckets that reach `min_count`; rows are sorted by bucket."""

    def total(blobs: list[bytes]) -> pa.RecordBatch:
        rows = pa.concat_tables([_unpack(b) for b in blobs])
        rows = rows.group_by(["lang", "phrase", "words"]).aggregate([("count", "sum")])
        rows = rows.filter(pc.or_(pc.greater_equal(rows["count_sum"], min_count), pc.equal(rows["words"], 0))).combine_chunks()
        columns = [rows["lang"].cast(pa.string()), rows["phrase"].cast(pa.string()), rows["words"].cast(pa.int32()), rows["count_sum"].cast(pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "words", "f"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != current and held:
                    yield from total(held)
                    held = []
                current = bucket
                held.append(blob)
        if held:
            yield from total(held)

    return run


def _count(rows: DataFrame, choose, n_buckets: int, min_count: int, totals: bool = False) -> DataFrame:
    """(lang, phrase, words, f) of the chosen phrases that occur `min_count` times."""
    n = min(MAX_PARTITIONS, max(width(rows.sparkSession), n_buckets))
    packed = rows.mapInArrow(_map_side(choose, n_buckets, totals), "bucket long, blob binary")
    merged = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    return cut(merged.mapInArrow(_merge(min_count), "lang string, phrase string, words int, f long"))


def count_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    sample_part: int = SAMPLE_PART, sample_count: int = SAMPLE_COUNT, filter_words: int = bloom.MAX_WORDS,
) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of 1 to `max_words` words that occurs `min_count` times in a language,
    and a row of no words a language with the number of all its words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-volume // BUCKET_BYTES))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(sample_part)) == 0)
    proposals = _count(sample, _sample_pass(max_words - 1), max(1, -(-n_buckets // sample_part)), sample_count)
    proposed = spark.sparkContext.broadcast(
        [bloom.build(proposals.where(F.col("words") == n), key_hashes(n), filter_words) for n in range(1, max_words)]
    )
    release(proposals)
    found = [_count(rows, _full_pass(proposed), n_buckets, min_count, totals=True)]
    for n in range(2, max_words + 1):
        parts = reduce(DataFrame.unionByName, found).where(F.col("words") == n - 1)
        # Frequent parts that the sample did not propose; where there are none, all extensions were counted.
        if parts.mapInArrow(_unproposed(proposed, n - 1), "lang string").isEmpty():
            continue
        frequent = spark.sparkContext.broadcast(bloom.build(parts, key_hashes(n - 1), filter_words))
        found.append(_count(rows, _expansion_pass(proposed, frequent, n), n_buckets, min_count))
    return reduce(DataFrame.unionByName, found)


def _unproposed(proposed, n: int):
    """Rows whose phrase the sample did not propose, or that have a part that it did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            miss = np.zeros(batch.num_rows, bool)
            phrases = [p.split(b" ") for p in encoded(batch.column("phrase"))]
            langs = Stretches(encoded(batch.column("lang"))).whole()
            words = Stretches([w for p in phrases for w in p]).whole().reshape(-1, n) if phrases else np.zeros((0, n), np.uint64)
            for size in range(1, n + 1):
                for k in range(n - size + 1):
                    miss |= ~contains(proposed.value[size - 1], reduce(chain, words.T[k : k + size], langs))
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").filter(pa.array(miss))})

    return run


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimal arithmetic of 38 digits."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    square = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, (left * right).cast("decimal(38,0)")).cast("long")


def phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, covered: int = COVERED,
    top: int = TOP, shard_rows: int = SHARD_ROWS, **how,
) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Words have A-Z lower-cased and no blank or tab; a phrase lies in one piece between `.,;:!?` and line
    ends. A candidate has 2 to `max_words` words and occurs a >= `min_count` times; it is scored by its
    weakest cut into two parts that occur l and r times, at a tie by the first; n is the number of the
    language's words. A candidate goes when a longer one that holds it occurs at least `covered`
    hundredths as often. Ranks are by score, then a, then phrase, which no two share. A null lang is
    `und`, a null or empty text has no words, rows that repeat count again, long texts are read whole;
    an empty table, or a language without candidates, gives no rows. Other columns are not read.
    """
    counts = cut(count_phrases(docs, lang_col, text_col, min_count, max_words, **how))
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ", -1)
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.col("words") - 1),
            lambda k: F.array(
                F.struct(k.alias("k"), F.lit(True).alias("first"), F.array_join(F.slice(word, F.lit(1), k), " ").alias("part")),
                F.struct(k.alias("k"), F.lit(False).alias("first"), F.array_join(F.slice(word, k + 1, F.col("words") - k), " ").alias("part")),
            ),
        )
    )
    sides = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", "c.first", "c.part")
    known = join_hot(sides, counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    halves = known.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    scored = halves.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    # Parts of two words or more of each longer candidate, with the most that one of those that hold it occurs.
    lengths = [(n, k) for n in range(2, max_words) for k in range(1, max_words - n + 2)]
    inner = F.array(*[F.when(F.col("words") > F.greatest(F.lit(n), F.lit(n + k - 2)), F.array_join(F.slice(word, k, n), " ")) for n, k in lengths]) if lengths else F.array()
    held = candidates.select("lang", F.explode(inner.cast("array<string>")).alias("phrase"), F.col("a").alias("longer")).where("phrase is not null")
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # Written once: the ranks below read it three times.
    kept = cut(
        weakest.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
        .select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shards = max(1, -(-kept.count() // shard_rows))
    ahead = kept.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
    ahead = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*best))).where(F.col("rank") <= top).drop("shard")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    report = ahead.withColumn("rank", rank).where(F.col("rank") <= top)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return report.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\x0C\r]')) as piece from t),
q as materialized (select lang, row_number() over () as id, regexp_extract_all(piece, '[^ \t]+') as words from p),
w as (select lang, id, unnest(words) as x, generate_subscripts(words, 1) as i from q),
v as (select lang, x, lead(x) over o as y, lead(x, 2) over o as z from w window o as (partition by id order by i)),
f as materialized (
  select lang, 1 as k, x as phrase, x, null as y, null as z, count(*) as f from v group by all
  union all select lang, 2, x || ' ' || y, x, y, null, count(*) from v where y is not null group by all
  union all select lang, 3, x || ' ' || y || ' ' || z, x, y, z, count(*) from v where z is not null group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as materialized (select lang, k as words, x, y, z, phrase, f as a from f where k >= 2 and f >= 10),
d as materialized (
  select lang, phrase, a, 1 as j, x as head, case words when 2 then y else y || ' ' || z end as tail from c
  union all select lang, phrase, a, 2, x || ' ' || y, z from c where words = 3),
s as (
  select d.lang, d.phrase, d.a, d.j, l.f as l, r.f as r, (1000000::hugeint * d.a * d.a // (l.f::hugeint * r.f))::bigint as score
  from d join f l on l.lang = d.lang and l.phrase = d.head join f r on r.lang = d.lang and r.phrase = d.tail),
b as (select *, row_number() over (partition by lang, phrase order by score, j) as place from s),
h as (
  select lang, phrase, max(a) as longer from (
    select lang, x || ' ' || y as phrase, a from c where words = 3
    union all select lang, y || ' ' || z, a from c where words = 3) group by 1, 2),
k as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score from b left join h on b.lang = h.lang and b.phrase = h.phrase
  where place = 1 and (h.longer is null or 100 * h.longer < 50 * b.a)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select o.lang, rank, phrase, a, l, r, n, score from o join n on o.lang = n.lang where rank <= 2000
"""
