import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import token_count as T

PATH = public_tokenizers.path(T.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TABLE = T.merge_table(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    assert TABLE.count(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'stre\n\t<|endoftext>12é²½ \x1cɐ日🎉_-")))
def test_mixed_text(text):
    assert TABLE.count(text) == library(text)
    if not T._OTHER.search(text):
        assert T._LATIN.findall(text) == regex.findall(T._PIECES, text)


def test_both_splits_agree_on_every_latin_character():
    for i in range(0x250):
        if not T._OTHER.search(chr(i)):
            for text in (f"a{chr(i)}1", f" {chr(i)} ", f"'{chr(i)}s"):
                assert T._LATIN.findall(text) == regex.findall(T._PIECES, text), i


def test_long_and_special(spark, docs, odd, none):
    texts = ["x" * 100_000, "ab" * 30_000, "a<|endoftext|>b", "<|endoftext|>" * 3, None, "", "the cat " * 2000]
    got = {r.doc_id: r for r in T.count_tokens(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes) == (library(text or ""), len((text or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    assert T.count_tokens(odd).count() == odd.count() and T.count_tokens(none).count() == 0
