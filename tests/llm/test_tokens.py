"""Token counts and the BPE automaton against the tokenizers library."""

import hashlib
import struct
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meltemi.llm.bpe_automaton import TokenAutomaton, decode, digests, encode
from meltemi.llm.token_count import MergeCounter, count_tokens
from meltemi.llm.vocab import Vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = Path(PATH).read_text(encoding="utf-8")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER, AUTOMATON = MergeCounter(Vocabulary(SOURCE)), TokenAutomaton(Vocabulary(SOURCE))

TEXTS = [
    None, "", "  \n\t", "The theatre, isn't it?", "a" * 300, "aaa aab abab" * 7, "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "ΑΣ ΣΑΣ İ",
    "café café", "日本語 🎉🎉 ½ ٣", "\x1ca\x1db\x85c d", "word " * 3000, "No!!! 12345 ###$$$", "No!!! 12345 ###$$$", "l'l 'll 's's",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    # Clashing names: n_tokens and ids are columns of the input too.
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(0, None, "x", 5), (None, "the", "x", 5)], "doc_id long, text string, ids string, n_tokens int")


def test_counts_match_the_library(docs):
    got = {r.doc_id: r for r in count_tokens(docs, SOURCE).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(expected(t)[0])), t
    assert got[None].n_tokens == 1


def test_round_trip_matches_the_library(docs):
    whole = encode(docs, SOURCE)
    got = {r.doc_id: r for r in whole.collect()}
    marks = {r.doc_id: r for r in digests(docs, SOURCE).collect()}
    again = {r.doc_id: r.decoded for r in decode(whole, SOURCE).collect()}
    for i, t in enumerate(TEXTS):
        ids, text = expected(t)
        assert (got[i].ids, got[i].decoded, again[i]) == (ids, text, text)
        assert marks[i].n_tokens == len(ids)
        assert marks[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert marks[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_rows_and_empty_tables(docs):
    assert count_tokens(docs, SOURCE).where("doc_id = 0").count() == 2
    none = docs.limit(0)
    assert count_tokens(none, SOURCE).count() == encode(none, SOURCE).count() == digests(none, SOURCE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdehinorst'12!é ßΣ.") | st.characters(max_codepoint=0x2FF), max_size=40))
def test_any_text(text):
    ids, decoded = expected(text)
    assert COUNTER.text(text) == len(ids)
    assert AUTOMATON.ids(text) == ids
    assert AUTOMATON.both(text)[1] == decoded


def test_an_arc_is_worked_out_once(monkeypatch):
    one, asked = TokenAutomaton(Vocabulary(SOURCE)), []
    whole = one.has_arc
    monkeypatch.setattr(one, "has_arc", lambda state, label: asked.append((state, label)) or whole(state, label))
    for k in range(300):
        text = f"qzx{'v' * (k % 7)}wkj{'bn' * (k % 5)}{'m' * (k // 35)}"
        assert one.ids(text) == expected(text)[0]
    assert asked and len(asked) == len(set(asked))


def test_automaton_paths_are_unique():
    # Every prefix of merged letters is read by one path only: the automaton refuses what merging would not leave.
    v = AUTOMATON.vocabulary
    for u, w, uw in v.merges[:2000]:
        assert not AUTOMATON.has_arc(u, w) or AUTOMATON.made[uw] < 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
