"""Fill-in-the-middle examples: a text cut into units, two cuts drawn from its id, the pieces put in another order.

One Arrow pass, no shuffle, no Python object a text or unit: ``pyarrow.compute`` splits all texts of a slice into lists
of units, flattens them with the index of their text, numbers the units of a text, filters them by role (prefix, middle,
suffix), rebuilds one list array a role and joins each list to one string. A slice is bounded in rows and in bytes, so memory
doesn't grow with the batch; a single text of any length is one slice and is cut whole.

Edge cases: null and empty texts have no units and stay plain; a null id draws as an empty string does; texts that hold a
marker stay plain, so an output can always be taken apart again; rows that repeat are transformed each on its own, equal
rows to equal outputs; other columns are never read, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from kuchikomi.llm.rows import texts

MOST_ROWS, MOST_BYTES = 2_000, 1 << 24


@dataclass(frozen=True)
class Plan:
    """Which documents are transformed, and how: both shares in percent."""

    rate: int = 100
    suffix_first: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def draws(seed: int) -> list[Column]:
    """Four unsigned numbers from the id's digits: the first 8-digit groups of a hex sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most ``MOST_ROWS`` rows and ``MOST_BYTES`` of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(max(int(np.searchsorted(ends, before + MOST_BYTES, side="right")), first + 1), first + MOST_ROWS)
            yield batch.slice(first, last - first)
            first = min(last, batch.num_rows)


def units(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts, each with its line feed, and for every line the index of its text."""
    lists = pc.split_pattern(values, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    last = np.append(parent[1:] != parent[:-1], True) if len(parent) else np.zeros(0, bool)
    ended = pc.binary_join_element_wise(flat, pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    lines = pc.if_else(pa.array(last), flat, ended)
    real = pc.greater(pc.binary_length(lines), 0)
    return lines.filter(real), parent[real.to_numpy(zero_copy_only=False)]


def rebuilt(lines: pa.Array, parent: np.ndarray, wanted: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` texts the wanted lines, joined."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[wanted], minlength=n))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), lines.filter(pa.array(wanted)))
    return pc.binary_join(lists, pa.scalar("", lines.type))


def joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))


def cut(batch: pa.RecordBatch, plan: Plan) -> dict[str, pa.Array]:
    """Units, form, pieces and output of every text of a slice."""
    values = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    rows = len(values)
    lines, parent = units(values)
    count = np.bincount(parent, minlength=rows)
    h = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
    one, two = h[0] % (count + 1), h[1] % (count + 1)
    ordinal = np.arange(len(parent)) - (np.cumsum(count) - count)[parent]
    role = (ordinal >= np.minimum(one, two)[parent]).astype(np.int8) + (ordinal >= np.maximum(one, two)[parent])
    prefix, middle, suffix = (rebuilt(lines, parent, role == r, rows) for r in range(3))

    plain = (count == 0) | (h[2] % 100 >= plan.rate)
    marks = [pa.scalar(m, pa.large_string()) for m in (plan.prefix, plan.suffix, plan.middle)]
    for mark in (plan.prefix, plan.suffix, plan.middle):
        plain |= pc.match_substring(values, mark).to_numpy(zero_copy_only=False)
    spm = pa.array(~plain & (h[3] % 100 < plan.suffix_first))
    plain = pa.array(plain)
    p, s, m = marks
    output = pc.if_else(plain, values, pc.if_else(spm, joined(s, suffix, p, prefix, m, middle), joined(p, prefix, s, suffix, m, middle)))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.large_string())
    pieces = {k: pc.if_else(plain, none, v) for k, v in (("prefix", prefix), ("middle", middle), ("suffix", suffix))}
    sizes = {f"{k}_chars": pc.utf8_length(v) for k, v in pieces.items()}
    return {"n": pa.array(count), "form": form, **pieces, **sizes, "output": output}


RESULT = "doc_id long, n long, form string, prefix string, middle string, suffix string, prefix_chars long, middle_chars long, suffix_chars long, output string"


def _mapped(df: DataFrame, text: str, function: Callable[[pa.RecordBatch], dict[str, pa.Array]], kind: StructType) -> DataFrame:
    """``function`` makes columns of every slice; those of the schema it doesn't make are handed through."""
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            made = function(part)
            yield pa.RecordBatch.from_arrays([(made[f.name] if f.name in made else part.column(f.name)).cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def transformed(docs: DataFrame, plan: Plan = Plan(), columns: tuple[str, ...] = ("doc_id", "n", "form", "output")) -> DataFrame:
    """The chosen columns of ``RESULT`` for every whole text; pieces and their sizes are null in plain rows."""
    kinds = dict(c.split() for c in RESULT.split(", "))
    drawn = texts(docs).select("doc_id", "text", *draws(plan.seed))
    return _mapped(drawn, "text", lambda part: cut(part, plan), StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in columns)))


def _parts(values: pa.Array, mark: str, index: int) -> pa.Array:
    return pc.list_element(pc.split_pattern(values, mark), index)


def taken_apart(batch: pa.RecordBatch, plan: Plan) -> pa.Array:
    """The texts behind outputs: split at the markers, which no transformed text holds itself."""
    output, form = batch.column("output").cast(pa.large_string()), batch.column("form")
    result = output
    for name, marks, order in (
        ("psm", (plan.prefix, plan.suffix, plan.middle), (0, 2, 1)),
        ("spm", (plan.suffix, plan.prefix, plan.middle), (1, 2, 0)),
    ):
        here = pc.equal(form, name)
        if not pc.any(here).as_py():
            continue
        # Rows of other forms are replaced by empty frames, so that every row splits into the same number of parts.
        rest = pc.if_else(here, output, "".join(marks))
        pieces = []
        for mark in marks[1:]:
            pieces.append(_parts(rest, mark, 0))
            rest = _parts(rest, mark, 1)
        pieces.append(rest)
        pieces[0] = pc.utf8_slice_codeunits(pieces[0], len(marks[0]))
        result = pc.if_else(here, joined(*(pieces[i] for i in order)), result)
    return result


def restored(examples: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``examples`` (``output`` and ``form`` among its columns) with the exact original text as ``restored``."""
    schema = StructType([*examples.schema.fields, StructField("restored", StringType())])
    return _mapped(examples, "output", lambda part: {"restored": taken_apart(part, plan)}, schema)


def digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Sizes of the pieces, and digests of outputs and of the texts rebuilt from them."""
    made = restored(transformed(docs, plan, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")), plan)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Line feeds as chr(10); list slices count from 1.
SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), pieces AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS s
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
