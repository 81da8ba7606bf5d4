"""Benchmark decontamination: Wu-Manber search of many word windows at once.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). A shift
table over blocks of two words tells how far the search may jump because no window can end nearby; where the
shift is zero, the block selects a bucket of candidate windows and a direct comparison of all words confirms.

Edge cases: null or wordless documents have no words and no hits; texts of any length are searched whole; items without
words are ignored; repeated item ids or texts count once; the windows of an item without an id hit words, but no id
stands for it among the items found; rows that repeat are searched and returned each on its own. Only ``doc_id`` and
``text`` are read, so other columns can't clash; ``clean`` hands all columns on as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import frames, keep, per_row, stored, texts

WINDOW = 10
BLOCK = 2
#: Lower-cases A-Z, keeps digits, letters and every byte from 0x80 on, and blanks the rest.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``words`` of each distinct window, with the sorted ids of the items it comes from."""
    cleaned = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for item, text in zip(batch.item_id, batch.text):
            found = words(text)
            for i in range(max(len(found) - window + 1, min(len(found), 1))):
                out.append((b" ".join(found[i : i + window]).decode(), item))
        return pd.DataFrame(out, columns=["words", "item_id"])

    cut_rows = per_row(cleaned, cut, "words string, item_id string")
    return cut_rows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


class WuManber:
    """Search tables for windows of one length."""

    def __init__(self, length: int, known: list[list[bytes]], owners: list[list[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in zip(known, owners):
            for end in range(self.block, length + 1):
                key = tuple(window[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets.setdefault(tuple(window[-self.block :]), []).append((window, items))

    def search(self, text: list[bytes]):
        """Yield the first word's position and the items of each occurrence."""
        at, n, block, length = self.length, len(text), self.block, self.length
        shift, jump = self.shift, self.jump
        while at <= n:
            key = tuple(text[at - block : at])
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            here = text[at - length : at]
            for window, items in self.buckets[key]:
                if window == here:
                    yield at - length, items
            at += 1


def _tables(rows: list[tuple[str, list[str]]]) -> list[WuManber]:
    by_length: dict[int, tuple[list, list]] = {}
    for joined, items in rows:
        window = joined.encode().split(b" ")
        known, owners = by_length.setdefault(len(window), ([], []))
        known.append(window)
        owners.append(items)
    return [WuManber(length, *by_length[length]) for length in sorted(by_length)]


def window_blocks(items: DataFrame, window: int = WINDOW, block_windows: int = 200_000) -> list:
    """The windows as broadcasts of about ``block_windows`` each, so what a task holds is bounded by the parameter.

    A window's block follows from a hash of its words, so none is missed or searched twice.
    """
    known = windows(items, window).persist()
    parts = max(1, -(-known.count() // block_windows))
    shared = []
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        shared.append(items.sparkSession.sparkContext.broadcast([(r.words, list(r.item_ids)) for r in rows.toLocalIterator()]))
    known.unpersist()
    return shared


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = 200_000) -> DataFrame:
    """``doc_id, n_words, hits, item_ids`` per row: positions of hit words and ids of the items that occur.

    Each block of windows is one pass over the documents. Between passes the rows are stored, so a machine holds one
    block's tables at a time.
    """
    out = texts(docs).select("doc_id", "text", F.lit(0).alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("item_ids"))
    for i, shared in enumerate(window_blocks(items, window, block_windows)):
        out = frames(stored(out, "searched") if i else out, _searcher(shared), out.schema)
    return out.drop("text")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs."""
    for i, shared in enumerate(window_blocks(items, window, block_windows)):
        docs = keep(stored(docs, "sieved") if i else docs, _sieve(shared))
    return docs


def _sieve(shared):
    built: list[WuManber] = []  # once per task

    def wanted(values: list[str]) -> list[bool]:
        if not built:
            built.extend(_tables(shared.value))
        return [not any(True for table in built for _ in table.search(w)) for w in map(words, values)]

    return wanted


def _searcher(shared):
    def run(batches):
        tables = _tables(shared.value)
        for batch in batches:
            counts, hits, ids = [], [], []
            for text, old_hits, old_ids in zip(batch.text, batch.hits, batch.item_ids):
                found = words(text)
                hit, items = set(old_hits), set(old_ids)
                for table in tables:
                    for start, owners in table.search(found):
                        hit.update(range(start, start + table.length))
                        items.update(owners)
                counts.append(len(found))
                hits.append(sorted(hit))
                ids.append(sorted(items))
            yield batch.assign(n_words=counts, hits=hits, item_ids=ids)

    return run


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The occurrences of each document as counts and a digest of the items found."""
    found = occurrences(docs, items)
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id::varchar as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
cuts as (
  select item_id, least(len(w), 10) as length, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0),
patterns as (select item_id, length, array_to_string(w[i:i + length - 1], ' ') as p from cuts group by all),
lengths as (select distinct length from patterns),
places as (select doc_id, w, length, unnest(range(1, len(w) - length + 2)) as i from doc_words, lengths),
grams as (select doc_id, length, i, array_to_string(w[i:i + length - 1], ' ') as p from places),
found as (select g.doc_id, g.i, g.length, q.item_id from grams g join patterns q on g.length = q.length and g.p = q.p),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + length)) as k from found) group by doc_id),
items as (
  select doc_id, count(item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
       sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words d left join hit h using (doc_id) left join items i using (doc_id)
"""
