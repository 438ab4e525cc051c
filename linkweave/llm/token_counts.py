"""Token counts by whole-token shortcut.

Before any text is read, each vocabulary string that a text can hold as a unit is encoded alone; those
that give one token are proven shortcuts and count one wherever they stand as a unit. Only the other
units are merged by the tokenizer, each distinct short one once while it is remembered. The proof is made
once on the driver and broadcast; it is bounded by the vocabulary.

The vocabulary must be separable (no piece crosses a unit's start), which is checked; else texts are
encoded whole.

Defined cases: null and empty texts have no bytes and no tokens; special strings inside a text are
ordinary text, as the library's default has it; long texts are counted whole; rows that repeat are
each returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import pieces
from linkweave.llm.support import append_columns, small_batches


@dataclass(frozen=True)
class TokenCount:
    """model: path of a sentencepiece model on the driver and the executors; limit: tokens over which a
    text is too long; remembered: distinct merged units that a task keeps, none of over unit_chars
    characters, which bounds its memory in bytes."""

    model: str = ""
    limit: int = 4096
    remembered: int = 300_000
    unit_chars: int = 32

    @property
    def path(self) -> str:
        return self.model or public_tokenizers.path("piece_bpe_32k.model")


def proven_units(sp: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    """Units that encode alone as one token, found by encoding every vocabulary string that begins a unit."""
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    heads = [n[1:] for n in names if n.startswith(pieces.MARK)]
    found = {u: 1 for u, ids in zip(heads, sp.encode(heads, num_threads=1), strict=True) if u and len(ids) == 1}
    # The lone marker, at a text's end, can't be given to the library alone: its text would be empty.
    found[""] = 3 if sp.is_unknown(sp.piece_to_id(pieces.MARK)) else 1
    return found


def proof(path: str) -> dict[str, int] | None:
    """The proven units of a model, or None if pieces cross units and texts must be encoded whole."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return proven_units(sp) if pieces.separable([sp.id_to_piece(i) for i in range(sp.get_piece_size())]) else None


class Counter:
    """Counts tokens of texts; holds the proven units and a bounded memory of merged ones."""

    def __init__(self, p: TokenCount, proven: dict[str, int] | None):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=p.path)
        self.proven = proven
        self.known = dict(proven or {})
        self.most = len(self.known) + p.remembered
        self.longest = p.unit_chars

    def _merged(self, units: list[str]) -> list[int]:
        """Token counts of units by the library; the texts it is given at once stay below some MB."""
        out: list[int] = []
        at = size = 0
        for i, u in enumerate(units):
            size += len(u)
            if size > 1_000_000 or i + 1 == len(units):
                out += map(len, self.sp.encode(units[at : i + 1], num_threads=1))
                at, size = i + 1, 0
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if self.proven is None:
            return self._merged(texts)
        out: list[int] = []
        for text in texts:
            found = pieces.units(text)
            known = self.known
            new = list(set(found).difference(known))
            long = [u for u in new if len(u) > self.longest]
            if new:
                if len(known) + len(new) - len(long) > self.most:
                    known = self.known = dict(self.proven)
                    new = list(set(found).difference(known))
                    long = [u for u in new if len(u) > self.longest]
                known.update(zip(new, self._merged(new), strict=True))
            out.append(sum(map(known.__getitem__, found)))
            # Long units are counted with their text alone.
            for u in long:
                del known[u]
        return out


def token_counts(docs: DataFrame, p: TokenCount = TokenCount(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(proof(p.path))

    def maker():
        counter = Counter(p, shipped.value)

        def compute(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            return [pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())]

        return compute

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return append_columns(rows, fields, maker, drop=("text",)).withColumn("over_limit", F.col("n_tokens") > p.limit)
