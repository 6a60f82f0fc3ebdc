"""Exact token counts of a sentencepiece BPE model, most words by a whole-token shortcut.

A text is cut into units: a run of spaces and what follows up to the next space.
What is proved once on the driver, from the model file (whole_tokens):

* no piece of the vocabulary holds a space behind another character, so no merge
  crosses the border of two units, and the order of merges inside a unit does
  not depend on what stands around it: a text has the sum of its units' tokens;
* the vocabulary strings in the returned list are units that the library encodes
  as one token each.

Those are counted directly. The other units are merged by the library, each
distinct one once a batch of memory, not once an occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship

LIMIT_TOKENS = 4096

#: How the vocabulary and the library write a space.
SPACE = "▁"
UNIT = re.compile(rb" +[^ ]*")
BORDER = re.compile(rb"[^ ](?= )")

#: Bytes of text that are cut into units at once, longest unit that is remembered, and number of units remembered.
WINDOW_BYTES, KEPT_BYTES, KEPT_UNITS = 1 << 20, 64, 1 << 18


def whole_tokens(model: bytes) -> list[bytes]:
    """The units (a space, then the word) that are one token each; raises ValueError where units of this model can't be counted one by one."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as spec

    proto = spec.ModelProto.FromString(model)
    kind, norm, of = proto.trainer_spec, proto.normalizer_spec, spec.ModelProto.SentencePiece
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if kind.model_type != spec.TrainerSpec.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or not plain:
        raise ValueError("units are counted for BPE with byte fallback, over texts as they are behind one added space")
    pieces = [(i, p.piece) for i, p in enumerate(proto.pieces) if p.type == of.NORMAL]
    if any(p.type in (of.USER_DEFINED, of.UNUSED) for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for _, p in pieces):
        raise ValueError("a piece crosses the border of two units, or pieces are fixed or left out")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    spaced = [(i, p) for i, p in pieces if p.startswith(SPACE)]
    told = library.encode([p[1:] for _, p in spaced], num_threads=1)  # the library adds the first space
    return [p.replace(SPACE, " ").encode() for (i, p), ids in zip(spaced, told, strict=True) if p == SPACE or ids == [i]]


class Costs(dict):
    """Unit to its tokens: 1 for whole tokens; what the library gives for others, remembered as far as memory is set aside."""

    def __init__(self, model: bytes, whole: tuple[bytes, ...]) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = frozenset(whole)
        super().__init__(dict.fromkeys(whole, 1))

    def __missing__(self, unit: bytes) -> int:
        n = len(self.library.encode(unit[1:].decode(), num_threads=1))
        if len(unit) <= KEPT_BYTES:
            self[unit] = n
        return n

    def of(self, text: bytes) -> tuple[int, int]:
        """(tokens, those counted by the shortcut) of a text; it is cut into units a window at a time."""
        if not text:
            return 0, 0
        data = b" " + text.replace(SPACE.encode(), b" ")
        tokens = direct = at = 0
        while at < len(data):
            border = BORDER.search(data, at + WINDOW_BYTES) if len(data) - at > 2 * WINDOW_BYTES else None
            end = border.end() if border else len(data)
            units = UNIT.findall(data, at, end)
            tokens += sum(map(self.__getitem__, units))
            direct += sum(map(self.whole.__contains__, units))
            at = end
            if len(self) > KEPT_UNITS + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
        return tokens, direct


@lru_cache(maxsize=2)
def _costs(model: bytes, whole: tuple[bytes, ...]) -> Costs:
    """One table a worker, however many tasks it runs."""
    return Costs(model, whole)


def token_counts(docs: DataFrame, model: bytes, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_whole (tokens by the shortcut) of every row of docs.

    model: the bytes of a sentencepiece file (half a MB), which go out with the
    tasks, so executors need no copy of it. Tokens are those of the library's
    encode(), without begin and end; strings of special tokens are ordinary text.
    There is no shuffle. A null text counts as empty: 0 tokens. Rows with a null
    doc_id and repeated rows are rows like others; of the other columns none is
    read, whatever they are called. doc_id can have any type.
    """
    ship(docs.sparkSession)
    whole = tuple(whole_tokens(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_whole bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = _costs(model, whole)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            counts = [costs.of(t.as_py()) for t in texts]
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, *n], names=["doc_id", "n_bytes", "n_tokens", "n_whole"])

    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")
