"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one array of bytes. Two cuts per text part it into prefix, middle and suffix,
and each part moves as a whole: it has one shift from its place in the batch to its place in the
output. The shifts are written into a difference array at the ends of the parts, a cumulative sum
turns them into one shift a byte, and one numpy scatter builds the outputs of the whole batch; the
sentinels go into the places left. Restoring finds the sentinels in the output, rebuilds the same
shifts from them and gathers the bytes back.

Scale: one pass, no shuffle. A batch is cut into chunks of about `words.BATCH_BYTES`; a longer text
is a chunk of its own, with about ten bytes of arrays for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.words import chunks

SEED, FIM_PERCENT, SPM_PERCENT = "7", 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
MARK = 3  # bytes of a sentinel
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: str, ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers a row from the hash of the seed and the id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _start(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sentinels in a run of bytes, and the letter of each."""
    at = np.flatnonzero(raw[:-2] == PREFIX[0]) if len(raw) >= MARK else np.zeros(0, np.int64)
    letter = raw[at + 1] if len(at) else np.zeros(0, np.uint8)
    hit = ((letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1])) & (raw[at + 2] == PREFIX[2])
    return at[hit], letter[hit]


def displacement(form, first, second, size, move) -> tuple[np.ndarray, np.ndarray]:
    """Shift of every byte of texts laid end to end, and where each one's three sentinels start in the output.

    Of each text: its form, the byte each cut is at, its size and `move`, what all of its bytes shift by
    before its parts trade places.
    """
    tail, plain, spm = size - second, form == PLAIN, form == SPM
    shift = np.stack(
        [
            np.where(plain, 0, np.where(spm, 2 * MARK + tail, MARK)),  # prefix
            np.where(plain, 0, 3 * MARK + tail),  # middle
            np.where(plain, 0, np.where(spm, MARK - second, 2 * MARK + first - second)),  # suffix
        ]
    ) + move
    start = _start(size)
    edge = np.zeros(int(start[-1]) + 1, np.int64)
    for low, high, by in zip((start[:-1], start[:-1] + first, start[:-1] + second), (start[:-1] + first, start[:-1] + second, start[1:]), shift, strict=True):
        np.add.at(edge, low, by)  # empty parts and texts share their places, so steps add up
        np.subtract.at(edge, high, by)
    out = start[:-1] + move
    sentinels = np.stack(
        [
            np.where(spm, out + MARK + tail, out),
            np.where(spm, out, out + MARK + first),
            out + 2 * MARK + first + tail,
        ]
    )
    return np.cumsum(edge[:-1], dtype=np.int64), sentinels[:, ~plain]


def transform(texts: list[bytes], h: np.ndarray, fim_percent: int, spm_percent: int) -> dict[str, np.ndarray]:
    """Cut and rearrange texts: n, form, prefix_chars, middle_chars and the outputs as bytes with offsets."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = _start(size)
    # A line ends after its line feed, or at the end of a text that does not end in one.
    stop = raw == 10
    last = start[1:][size > 0] - 1
    stop[last] = True
    ends = np.flatnonzero(stop) + 1
    before = np.searchsorted(ends, start, side="right")
    n = np.diff(before)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    place = np.concatenate([[0], ends])
    # The end of line k of a text is the k-th end after its start.
    first, second = (np.where(cuts[:, k] > 0, place[before[:-1] + cuts[:, k]], start[:-1]) - start[:-1] for k in (0, 1))
    at, _ = marks(raw)
    # A sentinel that starts in a text and ends in the next is none.
    of = np.searchsorted(start, at, side="right") - 1
    marked = np.zeros(len(texts), bool)
    marked[of[at + MARK <= start[of + 1]]] = True
    plain = (size == 0) | marked | (h[:, 2] % 100 >= fim_percent)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    new_size = size + np.where(plain, 0, 3 * MARK)
    new_start = _start(new_size)
    shift, sentinels = displacement(form, first, second, size, new_start[:-1] - start[:-1])
    out = np.empty(int(new_start[-1]), np.uint8)
    shift += np.arange(len(raw))
    out[shift] = raw
    for places, mark in zip(sentinels, (PREFIX, SUFFIX, MIDDLE), strict=True):
        out[places[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    points = _start((raw & 0xC0) != 0x80)
    lead, mid = (points[start[:-1] + b] - points[start[:-1] + a] for a, b in ((0, first), (first, second)))
    return {"n": n, "form": form, "plain": plain, "prefix_chars": lead, "middle_chars": mid, "bytes": out, "start": new_start}


def invert(outputs: list[bytes], form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs of the given forms were made of, as bytes with offsets."""
    out = np.frombuffer(b"".join(outputs), np.uint8)
    new_size = np.array([len(t) for t in outputs], np.int64)
    new_start = _start(new_size)
    at, letter = marks(out)
    of = np.searchsorted(new_start, at, side="right") - 1
    moved = form != PLAIN
    use = moved[of] & (at + MARK <= new_start[of + 1])
    at, letter, of = at[use] - new_start[of[use]], letter[use], of[use]
    place = np.zeros((3, len(outputs)), np.int64)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        here = letter == mark[1]
        if not np.array_equal(of[here], np.flatnonzero(moved)):
            raise ValueError("an output of form psm or spm must hold each sentinel once")
        place[k, of[here]] = at[here]
    p, s, m = place
    size = np.where(moved, new_size - 3 * MARK, new_size)
    first = np.where(form == PSM, s - MARK, np.where(form == SPM, m - p - MARK, 0))
    tail = np.where(form == PSM, m - s - MARK, np.where(form == SPM, p - MARK, size))
    start = _start(size)
    shift, _ = displacement(form, first, size - tail, size, new_start[:-1] - start[:-1])
    return out[shift + np.arange(len(shift))], start


def _strings(body: np.ndarray, start: np.ndarray) -> pa.Array:
    """Texts as an Arrow column; a chunk stays below its limit of 2 GB, as the rows it came from did."""
    return pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))


def _fill(seed: str, fim_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = _texts(batch.column("text")), batch.column("doc_id")
            for i, j in chunks(texts):
                got = transform(texts[i:j], draws(seed, ids.slice(i, j - i).to_pylist()), fim_percent, spm_percent)
                chars = {c: pa.array(got[c], pa.int64(), mask=got["plain"]) for c in ("prefix_chars", "middle_chars")}
                output = _strings(got["bytes"], got["start"])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids.slice(i, j - i), "n": pa.array(got["n"], pa.int64()), "form": pa.array(FORMS[got["form"]].tolist(), pa.string()), **chars, "output": output}
                )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """One row per input row: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    A line is `[^\\n]*\\n|[^\\n]+`. Both cuts, whether a text is moved and its form are drawn from the hash
    of seed and id, so reruns and rows that repeat an id draw alike; a null id draws as the word null.
    A null or empty text is plain with an empty output; so is, unchanged, a text that holds a sentinel
    and one that is not drawn; prefix_chars and middle_chars are null for plain. Texts of any length
    are moved whole. Both cuts may fall together or at an end: parts may be empty. An empty table gives
    an empty result; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fill(seed, fim_percent, spm_percent), SCHEMA)


def restore(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The texts of rows with (form, output), next to the columns of `carry`; null outputs give empty texts.

    Only form and output are read. An output of form psm or spm that does not hold each sentinel once raises.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = _texts(batch.column("_output"))
            forms = np.array([PLAIN if f is None else FORMS.tolist().index(f) for f in batch.column("_form").to_pylist()], np.int64)
            for i, j in chunks(outputs):
                text = _strings(*invert(outputs[i:j], forms[i:j]))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in carry] + [text], names=[*carry, "text"])

    given = rows.select(*carry, F.col("form").alias("_form"), F.col("output").alias("_output"))
    schema = "".join(f"`{c}` {t}, " for c, t in rows.select(*carry).dtypes) + "text string" if carry else "text string"
    return given.mapInArrow(run, schema)


SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, 'null')) as h from documents),
c as (
  select *, string_split(t, chr(10)) as lines,
    length(t) - length(replace(t, chr(10), '')) + (t <> '' and right(t, 1) <> chr(10))::int as n,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from c),
p as (
  select *, case when a = n then t when a = 0 then '' else array_to_string(lines[1:a], chr(10)) || chr(10) end as prefix,
    case when b = n then t when b = 0 then '' else array_to_string(lines[1:b], chr(10)) || chr(10) end as upto from k),
m as (
  select *, substr(upto, length(prefix) + 1) as middle, substr(t, length(upto) + 1) as suffix,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from p)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from m
"""
