import random

from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from vicinal.llm import bpe

PATH = bpe.default_path()
OURS = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
LIBRARY = Library.from_file(PATH)


def agree(texts):
    for t, (ids, raw) in zip(texts, OURS.encode(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)), repr(t)
        assert raw.decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


def test_texts_by_kind():
    agree(["", " ", "  a", "it's we'll  I'M\n\n x\t", "a" * 3000, "é" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "日本語テキスト 123４５", "½²Ⅷ १२ á", "\x1c\x1f\x85\xa0　z", "😀😀 👩‍👩‍👧", "​­-", "A" * 5 + " " * 4097])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(t):
    agree([t])


def test_syllable_words():
    r = random.Random(1)
    syl = "the and ing tion er re on en é ê ción ä sch ñ idiot ' , . ### 12".split()
    agree([" ".join("".join(r.choices(syl, k=r.randint(1, 9))) for _ in range(400)) for _ in range(20)])


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi there", "y"), (3, "hi there", "y")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode(df, PATH).select("doc_id", "n_tokens").collect()))
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.encode(df.limit(0), PATH).count() == 0
