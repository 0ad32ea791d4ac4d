"""Fill-in-the-middle, URL filter and phrase mining against brute force, with odd rows, repeats, ties and long texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bloom, fill_middle, phrases, url_filter

BIG = (1 << 60) + 1  # not a float
DOCS = "doc_id long, text string, lang string, n long, form string, output string, rid string, f string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x" if k else 7 for k in range(9 - len(r))]) for r in rows], DOCS)


def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out)


def test_fill_in_middle(spark):
    rng = random.Random(5)
    pieces = ["é\n", "\n", "日本 a", "x", "<P", ">", "<", "\r\n", "\v", "😀\n", "S>", "tail"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(BIG, "a\nb\nc"), (BIG, "a\nb\nc"), (None, "a\nb"), (None, None), (900, None), (901, ""), (902, "\n"), (903, "one line"), (904, "has <M> in\nit"), (-3, "a\nb\n")]
    rows += [(905, "".join(f"line {i}\n" for i in range(400_000))), (906, "word " * 900_000), (907, "\n" * 3_000_000)]
    out = fill_middle.fill_in_middle(frame(spark, [(*r, "en") for r in rows]))
    got = out.withColumn("sha", F.sha2("output", 256)).drop("output").collect()
    want = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest()) for w in (fim(*r) for r in rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fill_middle.restore(out, ("doc_id",)).select("doc_id", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_fill_in_middle_rates(spark):
    rows = [(i, "a\nb\nc\n", "en") for i in range(300)]
    forms = collections.Counter(r.form for r in fill_middle.fill_in_middle(frame(spark, rows), fim_percent=50, spm_percent=0).collect())
    assert forms["spm"] == 0 and 100 < forms["plain"] < 200
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0
    assert fill_middle.restore(fill_middle.fill_in_middle(frame(spark, []))).count() == 0
    bad = spark.createDataFrame([("psm", "no sentinels")], "form string, output string")
    with pytest.raises(Exception, match="each sentinel once"):
        fill_middle.restore(bad).collect()


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_filter(spark):
    rng = random.Random(6)
    labels, ends = ["a", "b", "net", "com", "example", "É"], ["", "/", "/en", "/en/", "/de/x", "/é/1", "/en/very/long"]
    urls = [rng.choice(["http://", "HTTPS://", "x", ""]) + ".".join(rng.choice(labels) for _ in range(rng.randrange(5))) + rng.choice(ends) + rng.choice(["", "?q=/en/", "#f"]) for _ in range(500)]
    urls += [None, "", "://", "://net", "http://NET/", "http://xnet/", "http://a.net./", "http://net:80/", "http://.net/", "http://a.net/\n?x", "http://" + "a." * 50_000 + "net/" + "y" * 200_000]
    pages = spark.createDataFrame(
        [(i, u, "n", "x", "y", "z") for i, u in enumerate(urls)] + [(None, "http://a.net/", "n", "x", "y", "z")] * 2 + [(BIG, "http://a.net/", "n", "x", "y", "z")] * 2,
        "page_id long, url string, host string, rule string, verdict string, rid string",
    )
    rules = [("net", "/", "block"), ("a.net", "/en", "allow"), ("Example", "", "block"), ("com", "/é/", "block"), ("b.com", "/", "allow"), ("", "/", "block"), ("net", "/en/", "block"), ("com", "/en/", "allow")]
    want = [(i, *judged(u, [(h.lower(), p, v) for h, p, v in rules])) for i, u in [*enumerate(urls), *[(None, "http://a.net/")] * 2, *[(BIG, "http://a.net/")] * 2]]
    listed = spark.createDataFrame([*rules, ("net", "/", "allow")], "host string, path string, verdict string")
    for words in (bloom.MAX_WORDS, 8):  # 8 words let many more keys through
        got = url_filter.url_filter(pages, listed, max_words=words).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_never_misses(spark):
    def keys(batch):
        return bloom.Stretches(bloom.encoded(batch.column("s"))).whole()

    words = bloom.build(spark.range(20_000).selectExpr("cast(id as string) as s"), keys)
    hashed = bloom.Stretches([str(i).encode() for i in range(60_000)]).whole()
    hits = bloom.contains(words, hashed)
    assert hits[:20_000].all() and hits[20_000:].mean() < 0.02


def mined(rows, least, longest, covered, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    vocab = [f"w{min(int(rng.expovariate(0.08)), 200)}" for _ in range(400)]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" "] * 12 + ["\t", ". ", ",", "\n", "  "]) for _ in range(rng.randrange(200))), rng.choice(["en", "en", "dé", None, "und", "en "])) for i in range(120)]
    rows += [(300, None, "en"), (301, "", None), (302, " .. \n", "xx"), (303, "NEW York city " * 40, "en"), (303, "new yorK City " * 40, "en"), (None, "É é É é É é É é É é É é", "en")]
    rows += [(400 + i, "same passage of text here", "en") for i in range(60)]
    return rows + [(500, "long words go on " * 20_000, "long")]


@pytest.mark.parametrize("how", [{}, {"sample_part": 1}, {"sample_part": 1 << 40}, {"sample_part": 2, "sample_count": 9}, {"filter_words": 8}, {"max_words": 4, "covered": 80, "min_count": 5}, {"top": 5, "shard_rows": 7}])
def test_phrases(spark, prose, how):
    want = mined(prose, how.get("min_count", 10), how.get("max_words", 3), how.get("covered", 50), how.get("top", 2000))
    got = phrases.phrases(frame(spark, prose), **how).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_strings_are_taken_where_they_lie():
    words = pa.array([b"", b"ab", b"", "é".encode(), b"c" * 300], pa.binary())
    for a in range(len(words) + 1):
        for b in range(a, len(words) + 1):
            part = words.slice(a, b - a)
            assert bytes(bloom.laid(part)) == b"".join(part.to_pylist())
            assert bloom.Stretches(part).whole().tolist() == bloom.Stretches(part.to_pylist()).whole().tolist()
    rows = phrases._unpack(phrases._pack(words.slice(1, 3), words.slice(2, 3), np.arange(3), np.array([5, 6, 7])))
    assert rows.to_pydict() == {"lang": [b"ab", b"", "é".encode()], "phrase": [b"", "é".encode(), b"c" * 300], "words": [0, 1, 2], "count": [5, 6, 7]}


def test_phrases_of_nothing(spark):
    assert phrases.phrases(frame(spark, [])).count() == 0
    assert phrases.phrases(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_scores_are_exact(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 10**13 + 9), (7, 7, 7), (10, 10**15, 10**15), (10**15, 10**15, 10**15 + 1)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())
