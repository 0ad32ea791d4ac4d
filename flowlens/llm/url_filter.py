"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A rule is a canonical (host, path); it fits a URL whose host is the rule's or one of its subdomains
and whose path starts with the rule's. A URL can thus fit one listed key for each of its host's
label suffixes and each listed path length. All of these keys are looked up in a blocked Bloom
filter (`bloom`). What passes goes to an exact join with the rules, which removes false positives;
of the rules that fit, the longest wins.

Scale: the filter is built from the rules in parallel and bounded, so its broadcast is; a fuller
filter lets more keys through, and the join still decides. URLs that hit nothing are never shuffled. A rule that
fits a third of all URLs is one of at most HOT_KEYS that are joined in place (`shared.join_hot`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bloom
from flowlens.llm.bloom import Stretches, encoded
from flowlens.llm.shared import join_hot
from flowlens.operators.lineage import cut

#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Bytes of host and path worked on at once.
BATCH_BYTES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Canonical host (A-Z lower-cased) and path of a URL; both empty for null and where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _rule_keys(batch: pa.RecordBatch) -> np.ndarray:
    return bloom.chain(*(Stretches(encoded(batch.column(c))).whole() for c in ("rule_host", "rule_path")))


def _probe(sent):
    """Canonical URLs with an identity and the keys that the filter lets through, longest first."""

    def keys(hosts: list[bytes], paths: list[bytes], words: np.ndarray, lengths: np.ndarray) -> list[list[dict]]:
        host, path = Stretches(hosts), Stretches(paths)
        # Label suffixes: from each host's start and from behind each of its dots.
        dots = np.flatnonzero(host.raw == ord(".")) + 1
        low = np.unique(np.concatenate([host.start[:-1][host.size > 0], dots]))
        of = np.searchsorted(host.start, low, side="right") - 1
        low, of = low[low < host.start[of + 1]], of[low < host.start[of + 1]]
        suffix = host.hash(low, host.start[of + 1])
        out: list[list[dict]] = [[] for _ in hosts]
        for length in lengths[::-1]:
            fits = path.size[of] >= length
            begin = path.start[of[fits]]
            hit = np.flatnonzero(fits)[bloom.contains(words, bloom.chain(suffix[fits], path.hash(begin, begin + length)))]
            for i, at in zip(of[hit].tolist(), (low[hit] - host.start[of[hit]]).tolist(), strict=True):
                out[i].append({"host": hosts[i][at:], "path": paths[i][:length]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = sent.value
        task, n = uuid.uuid4().hex, 0
        kind = pa.list_(pa.struct([("host", pa.binary()), ("path", pa.binary())]))
        for batch in batches:
            hosts, paths = encoded(batch.column("host")), encoded(batch.column("path"))
            found, at = [], 0
            while at < len(hosts):
                to, size = at, 0
                while to < len(hosts) and (to == at or size < BATCH_BYTES):
                    size += len(hosts[to]) + len(paths[to])
                    to += 1
                found += keys(hosts[at:to], paths[at:to], words, lengths)
                at = to
            rid = pa.array([f"{task}-{n + i}" for i in range(len(hosts))], pa.string())
            n += len(hosts)
            yield pa.RecordBatch.from_arrays(
                [rid, batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(found, kind)], names=["rid", "page_id", "host", "path", "keys"]
            )

    return run


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def url_filter(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", max_words: int = bloom.MAX_WORDS,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    `rules` has host, path and verdict (block or allow); its hosts are lower-cased, a null host or path
    counts as empty, an empty host fits nothing, an empty path fits every path. Of the rules that fit,
    the one with the longest host and path together wins, of these the longer host; of a key listed
    twice, block. A URL that no rule fits gets `otherwise` and a null rule: what is not listed passes.
    A URL that is null or has no `://` has an empty host and path and fits nothing. Rows that repeat an
    id or a URL are judged one by one; null ids too. Hosts and paths of any length are read whole. An
    empty table gives an empty result, an empty list fits nothing; other columns are not read.
    """
    spark = pages.sparkSession
    listed = cut(
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
        ).where("rule_host <> ''").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    )
    # As many numbers as there are different path lengths in the list.
    lengths = np.array(sorted(r[0] for r in listed.select(F.octet_length("rule_path")).distinct().collect()), np.int64)
    sent = spark.sparkContext.broadcast((bloom.build(listed.select("rule_host", "rule_path"), _rule_keys, max_words), lengths))
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    probed = cut(rows.mapInArrow(_probe(sent), "rid string, page_id long, host string, path string, keys array<struct<host: binary, path: binary>>"))
    hits = probed.select("rid", F.explode("keys").alias("key")).select("rid", F.col("key.host").cast("string").alias("rule_host"), F.col("key.path").cast("string").alias("rule_path"))
    true = join_hot(hits, listed, ["rule_host", "rule_path"])
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = true.groupBy("rid").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), size).alias("best"))
    return probed.join(best, "rid", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


SQL = """
with p as (
  select row_number() over () as rid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select *, regexp_extract(rest, '^[^/?#]*') as raw_host from p),
u as (
  select rid, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from h),
r(rule_host, rule_path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (
  select u.rid, rule_host || rule_path as rule, verdict,
    row_number() over (partition by rid order by length(rule_host) + length(rule_path) desc, length(rule_host) desc) as k
  from u join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, f.rule, coalesce(f.verdict, 'allow') as verdict from u left join f on u.rid = f.rid and f.k = 1
"""
