"""Token counts of whole texts by a sentencepiece model, in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from podium.llm.common import chunks, ship, texts

#: Bytes of text for each call of the library, and code points from which a text is split.
BATCH, LONG = 1 << 18, 1 << 15
#: How the library writes a space inside pieces.
MARK = "▁"


@cache
def _model(path: str):
    """The processor, and whether a space after another character is a safe place to split.

    It is if no piece goes on past such a place and if the library adds the mark of a space before
    each text by itself; the space that the split takes away is then restored.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    probe = "ab  cd \n eéf <s> 12, ab"
    same = model.encode(probe) == model.encode("ab") + [i for p in (" cd", "\n", "eéf", "<s>", "12,", "ab") for i in model.encode(p)]
    return model, same and not inner


def split(text: str, most: int) -> list[str]:
    """Parts of about ``most`` code points whose tokens, one after the other, are the whole text's.

    Cuts go to a space between a character that isn't one and any further character; the space
    itself is left out. A text without such a place stays whole.
    """
    parts, at = [], 0
    while len(text) - at > most:
        to = text.find(" ", at + most)
        while to > 0 and text[to - 1] in (" ", MARK):
            to = text.find(" ", to + 1)
        if to < 0 or to + 1 >= len(text):
            break
        parts.append(text[at:to])
        at = to + 1
    return [*parts, text[at:]]


def lengths(model, safe: bool, batch: list[str], most: int = LONG) -> np.ndarray:
    """Tokens of each text; no begin, end or added special tokens."""
    parts, owner = [], []
    for i, text in enumerate(batch):
        own = split(text, most) if safe and len(text) > most else [text]
        parts += own
        owner += [i] * len(own)
    sizes = np.fromiter(map(len, model.encode(parts, num_threads=1)), np.int64, len(parts))
    out = np.zeros(len(batch), np.int64)
    np.add.at(out, owner, sizes)
    return out


def token_counts(documents: DataFrame, path: str, limit: int = 4096, batch: int = BATCH) -> DataFrame:
    """``doc_id, n_bytes long, n_tokens long, over_limit boolean`` of every row; null texts are empty.

    Rows keep their number and multiplicity, null ids included; other columns are ignored. Each call
    of the library gets about ``batch`` bytes, so memory doesn't depend on how rows fall into batches.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, safe = _model(path)
        for part in chunks(batches, "text", batch):
            n = lengths(model, safe, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(documents).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
