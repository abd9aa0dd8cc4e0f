import importlib.util
import random

import pytest
from aerolith.llm import bytebpe
from aerolith.llm.pretokens import Words, portions, split

PATH = f"{bytebpe.VOCABULARIES}/{bytebpe.BYTE_BPE}"
ALPHABET = [*"'strevlmdaZ19!_\n\t \x00\"", "  ", "é", "ß", "漢", "😀", "́", " ", " ", "٣", "\r\n", "　", "<|endoftext|>", "ſ", "\x1c", "\x85", "​", "﻿", "'ll", "'re"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{bytebpe.VOCABULARIES}/__init__.py")
    p = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(p)
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bytebpe.ranks(PATH), special_tokens={})


def test_equal_to_the_library(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(8000)]
    texts += ["", "'s", "'", "''s", " 's", "\n's", "a" * 3000, "\x00" * 300, " " * 50, "x'sun 'tis"]
    texts += [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000]
    offsets, ids = bytebpe.Encoder(PATH).encode(texts)
    for i, t in enumerate(texts):
        got = ids[offsets[i] : offsets[i + 1]].tolist()
        assert got == library.encode_ordinary(t), repr(t)
        assert bytebpe.decoded(got, PATH) == t
    assert bytebpe.Encoder(PATH).lengths(texts).tolist() == [b - a for a, b in zip(offsets, offsets[1:])]


def test_slices_cover_the_text_and_small_caches_change_nothing(library):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(200)) for _ in range(60)]
    b = split(texts)
    assert b.length.sum() == sum(len(t.encode()) for t in texts)
    e = bytebpe.Encoder(PATH)
    e.words = Words(most=20)
    for a, z in portions(texts, 500):
        o, ids = e.encode(texts[a:z])
        for i in range(a, z):
            assert ids[o[i - a] : o[i - a + 1]].tolist() == library.encode_ordinary(texts[i])


def test_query(spark, data, library):
    from aerolith.llm.queries import p7_ids
    from aerolith.plans.tables import table

    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = p7_ids(spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows.keys() == docs.keys() and all(rows[k] == library.encode_ordinary(t or "") for k, t in docs.items())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.ids) for r in bytebpe.encoded(odd, "doc_id", "text").collect()) == [(0, [64, 275]), (1, []), (2, [])]
    assert bytebpe.encoded(odd.limit(0), "doc_id", "text").count() == 0


def test_any_text(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = bytebpe.Encoder(PATH)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
    def check(texts):
        o, ids = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == [library.encode_ordinary(t) for t in texts]

    check()
