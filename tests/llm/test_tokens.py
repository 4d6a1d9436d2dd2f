from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens

with open(tokens.VOCABULARY, "rb") as f:
    ENCODE = tokens.encoder(f.read()).encode_ordinary
COUNT = lambda x: len(ENCODE(x))
TEXT = st.text(alphabet="ab'sé1  \n\t.é世", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 12), TEXT), max_size=6), st.integers(1, 12))
def test_edits_count_like_encoding_anew(text, edits, leaf):
    tree = tokens.TokenTree(text, COUNT, leaf)
    assert tree.n_tokens == COUNT(text)
    for at, size, new in edits:
        a = min(at, len(text))
        b = min(a + size, len(text))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.n_chars == len(text) and tree.n_tokens == COUNT(text)


def test_only_a_region_is_encoded_again():
    text = "some words that go on " * 5000
    tree = tokens.TokenTree(text, COUNT)
    tree.edit(50000, 50004, "other")
    assert tree.encoded < 4 * tokens.LEAF and tree.n_tokens == COUNT(text[:50000] + "other" + text[50004:])


def test_query_against_brute_force(spark):
    texts = ["Write to a.b@c.org or +1 (736) 555-2678 now", None, "", "x" * 5000, "a " * 3000 + "me@x.yz " * 20, "<|endoftext|> 12"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], 1)], "doc_id long, text string, n_tokens int")
    for r in tokens.token_counts(df).collect():
        text = (texts[r.doc_id] if r.doc_id is not None else texts[0]) or ""
        edited = text
        for a, b, new in tokens.mask_edits(text):
            edited = edited[:a] + new + edited[b:]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars) == (COUNT(text), COUNT(edited), len(text))
    assert tokens.mask_edits(texts[0])[0][2] == "<phone>" and len(tokens.mask_edits(texts[0])) == 2
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_kept_trees_follow_batches_of_edits(spark, tmp_path):
    texts = ["some words that go on " * 2000, None, "", "short one"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leaf_chars string")
    tokens.token_trees(df).write.parquet(str(tmp_path / "0"))
    trees = spark.read.parquet(str(tmp_path / "0"))
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {i: COUNT(t or "") for i, t in enumerate(texts)}
    batches = [[(0, 1, 500, 504, "other"), (0, 2, 30_000, 30_001, "x" * 3000), (2, 1, 0, 0, "now some"), (9, 1, 0, 0, "no such")], [(0, 1, 100, 20_000, None), (3, 1, 0, 5, "long"), (3, 2, 4, 4, "er"), (1, 1, 0, 0, "a b"), (1, 2, None, 1, "z")]]
    for n, batch in enumerate(batches, 1):
        edits = spark.createDataFrame(batch, "doc_id long, ord int, start int, end int, new string")
        tokens.edit_trees(trees, edits).write.parquet(str(tmp_path / str(n)))
        trees = spark.read.parquet(str(tmp_path / str(n)))
        for i, _, a, b, new in batch:
            if i < len(texts) and a is not None:
                t = texts[i] or ""
                texts[i] = t[:a] + (new or "") + t[b:]
        for r in trees.collect():
            assert r.text == texts[r.doc_id] and r.n_tokens == COUNT(texts[r.doc_id] or "") and sum(r.leaf_chars) == len(texts[r.doc_id] or "")
            touched = r.doc_id in {x[0] for x in batch if x[2] is not None}
            assert (r.n_chars_encoded_again == 0) if not touched else r.n_chars_encoded_again <= 3000 + 12 * tokens.LEAF
