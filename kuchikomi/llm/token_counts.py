"""Token counts: a vocabulary compiled into a deterministic transducer whose transitions carry emitted counts.

A state holds, for every border inside the word from which a token could still reach past the current place, where
in the vocabulary's trie that token would be, the token that ends at the border and how many tokens lie between.
Reading a symbol decides the one token that ends there (its left neighbour must be compatible), so a transition
emits the change of the count, and no merging is done. Transitions are made when first needed and kept.

Texts are cut into chunks. Whatever the state on entry, it is settled at the first blank, so a chunk's map from
entry state to exit state and count is its opening up to a blank, the count between, and its ending after the last
blank. Maps compose associatively; they are reduced pairwise. Documents beyond one chunk are spread chunk by chunk.

Edge cases: null texts count as empty; texts without any blank are one opening, counted when the maps are composed;
rows that repeat an id are counted each on its own; texts of any length are counted whole; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import per_row, texts
from kuchikomi.llm.vocabulary import MOST_KEPT, Memory, Vocabulary, kept, shared_file

CHUNK_CHARS = 1 << 16
BLANKS = b" \t\n\r\x0b\x0c"


class Transducer:
    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.known = Memory(self.chunk)
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count."""
        child, token, inner = self.vocabulary.trie
        open_borders, emitted, last = [], None, -1
        for node, before, since in self.states[state]:
            reached = child.get(node << 16 | symbol)
            if reached is None:
                continue
            open_borders.append((reached, before, since))
            found = token[reached]
            if found >= 0 and (before < 0 or self.vocabulary.compatible(before, found)):
                emitted, last = 1 - since, found
        after = tuple((node, before, since + emitted) for node, before, since in open_borders if inner[node]) + ((0, last, 0),)
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        made = self.moves[state << 16 | symbol] = self.number[after], emitted
        return made

    def word(self, word: str) -> int:
        if len(self.moves) > 2 * MOST_KEPT:
            self._forget()
        state = total = 0
        for symbol in self.vocabulary.symbols(word):
            made = self.moves.get(state << 16 | symbol) or self.move(state, symbol)
            state, total = made[0], total + made[1]
        return total

    def chunk(self, chunk: bytes) -> int:
        """Tokens between two blanks."""
        return sum(1 if isinstance(p, int) else self.word(p) for p in self.vocabulary.pieces(chunk))

    def between(self, text: bytes) -> int:
        return sum(map(self.known.__getitem__, text.split()))

    def state_map(self, text: bytes) -> tuple[bytes, int, bytes | None]:
        """Opening, count between, ending; the ending is None if there is no blank at all."""
        first = next((i for i, b in enumerate(text) if b in BLANKS), None)
        if first is None:
            return text, 0, None
        last = max(text.rfind(bytes([b])) for b in BLANKS)
        return text[:first], self.between(text[first:last]), text[last + 1 :]

    def compose(self, left: tuple, right: tuple) -> tuple:
        if left[2] is None:
            return (left[0] + right[0], *right[1:])
        if right[2] is None:
            return left[0], left[1], left[2] + right[0]
        return left[0], left[1] + right[1] + self.between(left[2] + right[0]), right[2]

    def total(self, maps: list[tuple]) -> int:
        """The count of a whole text from its chunks' maps in order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        opening, count, ending = maps[0]
        return self.between(opening) + count + (self.between(ending) if ending else 0)


def token_counts(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""
    shared = shared_file(docs.sparkSession, path)
    whole = texts(docs)
    long = F.length("text") > chunk_chars

    def short_counts(batch: pd.DataFrame) -> pd.DataFrame:
        machine = kept(shared, "transducer", Transducer)
        data = [t.encode("utf-8", "replace") for t in batch.text]
        return pd.DataFrame({"doc_id": batch.doc_id, "n_bytes": [len(d) for d in data], "n_tokens": [machine.between(d) for d in data]})

    def maps(batch: pd.DataFrame) -> pd.DataFrame:
        machine = kept(shared, "transducer", Transducer)
        data = [t.encode("utf-8", "replace") for t in batch.text]
        made = [machine.state_map(d) for d in data]
        columns = dict(zip(("opening", "count", "ending"), map(list, zip(*made))))
        return batch[["row", "doc_id", "chunk"]].assign(n_bytes=[len(d) for d in data], **columns)

    def composed(batch: pd.DataFrame) -> pd.DataFrame:
        machine = kept(shared, "transducer", Transducer)
        counts = [machine.total([(m["opening"], m["count"], m["ending"]) for m in row]) for row in batch.maps]
        return pd.DataFrame({"doc_id": batch.doc_id, "n_bytes": batch.n_bytes, "n_tokens": counts})

    result = "doc_id long, n_bytes long, n_tokens long"
    short = per_row(whole.where(~long), short_counts, result)
    chunks = (
        whole.where(long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk_chars).cast("int") - 1)).alias("chunk"))
        .select("row", "doc_id", "chunk", F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars)).alias("text"))
        .repartition("row", "chunk")
    )
    mapped = per_row(chunks, maps, "row long, doc_id long, chunk int, n_bytes long, opening binary, count long, ending binary")
    gathered = mapped.groupBy("row", "doc_id").agg(
        F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("chunk", "opening", "count", "ending"))).alias("maps")
    )
    return short.unionByName(per_row(gathered, composed, result))


def counted(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    return token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
