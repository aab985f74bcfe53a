"""Token counts against the library itself."""

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import queries, tokens
from tests.llm.rows import awkward, frame

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
with open(FILE, "rb") as f:
    VOCABULARY = tokens.Vocabulary(f.read())
COUNT = tokens.Counts(VOCABULARY).tokens


def test_proof():
    assert VOCABULARY.marks_lead and VOCABULARY.dummy_mark
    assert "▁the" in VOCABULARY.whole and "▁the▁" not in VOCABULARY.whole
    assert all(len(p) == 1 or p in VOCABULARY.whole or tokens.alone(LIBRARY, p) > 1 for p in VOCABULARY.whole)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁ab<>/s")), max_size=60))
def test_any_text(text):
    assert COUNT(text) == len(LIBRARY.encode(text))


def test_spaces_specials_and_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", len(VOCABULARY.whole) + 3)
    for text in ["", " ", "  ", " " * 70 + "x", "<s></s><unk>", "▁▁x ▁", "a\r\n b", "日本 語\U0001f642", "\x00a", "unbelievable " * 50]:
        assert COUNT(text) == len(LIBRARY.encode(text)), text


def test_documents(spark, sf):
    got = {r.doc_id: r for r in queries.op6_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(LIBRARY.encode(r.text))
        assert got[r.doc_id][1:] == (len(r.text.encode()), n, n > 4096)


def test_awkward_rows(spark):
    rows = awkward()
    got = tokens.count_tokens(frame(spark), FILE, limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), len(LIBRARY.encode(r[1] or "")), len(LIBRARY.encode(r[1] or "")) > 100) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(frame(spark, []), FILE).count() == 0
