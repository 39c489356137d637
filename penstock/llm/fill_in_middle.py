"""Fill-in-the-middle: every text is cut at two seeded places and its parts change places.

1. Each task numbers the different texts it meets, by comparing their bytes, and sends each of them once; its other copies travel as a
   reference (task, number). So copies are pre-aggregated where they are read.
2. References and texts meet by a hash of the text. There the texts under a hash are compared byte by byte, so that a group is one content
   and not one hash; for each content the list of code point boundaries is made once and kept as an Elias-Fano list
   (about two bits a code point, plus low bits where code points take more bytes).
3. The rows of a group stream past its list: a document's two cuts are two selects, and the bytes between them are the parts.

Texts of which a thousandth of all rows (1,000 at least) are copies are spread over ``SALTS`` keys by the task they come from; each key
makes their list once.

The parts: n code points; h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``. The prefix ends after the
smaller, the middle after the larger of h1 % (n + 1) and h2 % (n + 1). The form is plain where the text is empty, holds a mark
(``<P>``, ``<S>``, ``<M>``) or h3 % 100 >= 100 - plain_percent; else spm if h4 % 100 < spm_percent, else psm.

Nulls and edge cases: a null text is an empty one; a null doc_id counts as an empty string in the seed; repeated rows give the same
result each; prefix, middle and suffix may each be empty; ties of the two cuts leave an empty middle; texts of any length are
held one at a time and cut whole; an empty table gives an empty result; carried columns may have any name but those of
the results (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, reserve

MARKS = ("<P>", "<S>", "<M>")
#: Over so many keys the copies of a very frequent text are spread.
SALTS = 64
#: A text is very frequent from so many copies on, or a thousandth of all rows where that is more.
HOT_COPIES = 1000
#: Bytes of texts a task remembers to recognise copies, and bytes of results in a batch.
REMEMBERED, BATCH = 16 << 20, 2 << 20
#: Bytes of the upper bits between two entries of a list's directory.
STEP = 64


class Boundaries:
    """The byte places at which the code points of a UTF-8 text begin, and its end, as an Elias-Fano list."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size)
        self.n = at.size - 1
        self.low_bits = max(0, ((raw.size + 1) // at.size).bit_length() - 1)
        ones = (at >> self.low_bits) + np.arange(at.size)
        upper = np.zeros(int(ones[-1]) + 1, np.uint8)
        upper[ones] = 1
        self.upper = np.packbits(upper, bitorder="little")
        self.lower = np.packbits((at[:, None] >> np.arange(self.low_bits) & 1).astype(np.uint8).ravel(), bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(self.upper).astype(np.int64), np.arange(0, self.upper.size, STEP))
        self.before = np.cumsum(counts) - counts

    def select(self, i: int) -> int:
        """Byte place of code point i; of the end for i = n."""
        block = int(np.searchsorted(self.before, i, "right")) - 1
        bits = np.unpackbits(self.upper[block * STEP : (block + 1) * STEP], bitorder="little")
        place = block * STEP * 8 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.lower[bit >> 3]) >> (bit & 7) & 1) << k
        return (place - i) << self.low_bits | low


def number_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the text's number in it; only the first row of a number keeps the text."""
    task, known, held, count = TaskContext.get().partitionId(), {}, 0, 0
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        numbers, first = [], []
        for key, text in zip(batch.column(batch.schema.get_field_index("_key")).to_pylist(), batch.column(at)):
            content = text.as_buffer().to_pybytes()
            same = known.setdefault(key, [])
            number = next((k for k, other in same if other == content), -1)
            first.append(number < 0)
            if number < 0:
                number, count, held = count, count + 1, held + len(content) + 100
                same.append((number, content))
            numbers.append(number)
            if held > REMEMBERED:
                known, held = {}, 0
        columns = batch.columns
        columns[at] = pc.if_else(pa.array(first, pa.bool_()), batch.column(at), pa.scalar(None, batch.column(at).type))
        yield pa.record_batch([*columns, pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(numbers, pa.int64())], [*batch.schema.names, "_task", "_number"])


def cut_texts(carry: list[str], plain_percent: int, spm_percent: int) -> callable:
    """Results of rows that come in order of key, task and number, a number's text with its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, group = None, None, None
        contents: list[tuple[bytes, Boundaries, bool]] = []
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_key", "_task", "_number", "_text", "_seed")}
            keys, tasks, numbers = (col[c].to_pylist() for c in ("_key", "_task", "_number"))
            seeds = [np.frombuffer(x, ">u4") for x in col["_seed"].to_pylist()]
            start, size = 0, 0
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if keys[i] != key:
                    key, contents = keys[i], []
                if (keys[i], tasks[i], numbers[i]) != number:
                    number = keys[i], tasks[i], numbers[i]
                    text = col["_text"][i].as_buffer().to_pybytes()
                    group = next((x for x in contents if x[0] == text), None)
                    if group is None:
                        group = text, Boundaries(text), any(m.encode() in text for m in MARKS)
                        contents.append(group)
                out.append(one(group, *(int(x) for x in seeds[i])))
                size += len(out[-1][-1])
                if size > BATCH or i + 1 == batch.num_rows:
                    n, form, prefix, middle, made = zip(*out)
                    arrays = {c: batch.column(batch.schema.get_field_index(c)).slice(start, len(out)) for c in carry}
                    arrays |= {"n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64())}
                    arrays["output"] = pa.array(made, pa.binary()).cast(pa.string())
                    yield pa.record_batch(list(arrays.values()), list(arrays))
                    start, size, out = i + 1, 0, []

    def one(group: tuple[bytes, Boundaries, bool], h1: int, h2: int, h3: int, h4: int) -> tuple:
        text, index, marked = group
        n = index.n
        if not n or marked or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        x, y = index.select(a), index.select(b)
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
        return n, "psm", a, b - a, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle

    return run


def fill_in_middle(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """carry, n, form, prefix_chars, middle_chars and the output of each row."""
    reserve(carry, ["n", "form", "prefix_chars", "middle_chars", "output", "_text", "_key", "_seed", "_salt", "_task", "_number"])
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text)
    hot = hot_keys(docs.select(key.alias("k")), "k", HOT_COPIES)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*carry, F.unhex(F.substring(digest, 1, 32)).alias("_seed"), key.alias("_key"), text.alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_text", T.StringType()), T.StructField("_task", T.IntegerType()), T.StructField("_number", T.LongType())])
    salt = F.when(F.col("_key").isin(hot), F.pmod("_task", F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    numbered = rows.mapInArrow(number_texts, schema).withColumn("_salt", salt)
    # Rows of a (task, number) stay together, the one with the text first.
    grouped = numbered.repartition("_key", "_salt").sortWithinPartitions("_key", "_task", "_number", F.col("_text").isNull())
    result = T.StructType([*[docs.schema[c] for c in carry], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return grouped.mapInArrow(cut_texts(list(carry), plain_percent, spm_percent), result)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: no part holds a mark, so the first of each kind is the one that was put in."""
    p, s, m = (F.instr(output, F.lit(x)) for x in MARKS)
    end = F.length(output)
    part = lambda a, b: F.substr(output, a + 3, b - a - 3)  # noqa: E731  between the marks at a and b
    psm = F.concat(part(F.lit(1), s), part(m, end + 1), part(s, m))
    spm = F.concat(part(p, m), part(m, end + 1), part(F.lit(1), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and SHA-256 of the output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
