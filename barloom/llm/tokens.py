"""Token counts of a SentencePiece BPE model without running the model over every text.

A merge never crosses certain places: before a word mark (the library's stand-in for a space) that follows another
character, if no piece has a mark there, and around every character that is in no piece of two or more characters.
Both are read off the vocabulary, not assumed. Texts are cut at these places into pre-tokens, whose counts add up.
A pre-token that is itself a vocabulary string and was proven offline to encode alone as one token counts 1; all
others are merged by the library once per task and remembered (a bounded memory).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from barloom.llm.common import texts_of

MARK = "▁"
#: Counts a task remembers before it starts anew.
MEMORY = 400_000


class Vocabulary:
    """What the vocabulary proves: places where no merge crosses, and strings that are one token alone."""

    def __init__(self, model: bytes):
        self.model = model
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        longer = [p for p in pieces if len(p) > 1]
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in longer)
        self.dummy_mark = sp.encode("\n", out_type=str)[:1] == [MARK]
        self.joinable = "".join(sorted(set("".join(longer)) - {MARK}))
        if not (self.marks_lead and self.dummy_mark and "\n" not in self.joinable):
            raise ValueError("the cuts between pre-tokens do not hold for this model")
        self.whole = {p for i, p in zip(ids, pieces, strict=True) if alone(sp, p) == 1}
        chars = re.escape(self.joinable)
        self.cut = re.compile(f"{MARK}*[{chars}]+|{MARK}+|[^{chars}{MARK}]")


def alone(sp: sentencepiece.SentencePieceProcessor, unit: str) -> int:
    """Tokens of a pre-token between two cuts. The library puts a mark before every text: used if there is one,
    else fenced off by a line feed, which joins with nothing."""
    if unit.startswith(MARK):
        return len(sp.encode(unit[1:].replace(MARK, " "))) if len(unit) > 1 else 1
    return len(sp.encode("\n" + unit.replace(MARK, " "))) - 2


class Counts(dict):
    """Pre-token -> number of tokens, filled on demand."""

    def __init__(self, known: Vocabulary):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=known.model)
        self.known = known
        super().__init__(dict.fromkeys(known.whole, 1))

    def __missing__(self, unit: str) -> int:
        if len(self) > MEMORY:
            self.clear()
            self.update(dict.fromkeys(self.known.whole, 1))
        n = self[unit] = alone(self.sp, unit)
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.known.cut.findall(MARK + text.replace(" ", MARK))))


def counter(model: bytes) -> Callable[[str], int]:
    return Counts(Vocabulary(model)).tokens


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token counts of every whole text.

    ``model_file`` is read on the driver (a vocabulary, hence of bounded size) and goes to the tasks with the function,
    so executors need not see the path. Null and empty texts have no bytes and no tokens; repeated rows are counted
    each; no rows give no rows; other columns of ``docs`` are not read.
    """
    with open(model_file, "rb") as f:
        known = Vocabulary(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Counts(known).tokens
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = [tokens(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
