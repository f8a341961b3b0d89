import pytest

LONG = "wörd and more words of a text " * 20_000
#: Texts at the edges: missing, empty, blank, very long, repeated, with odd characters.
TEXTS = [None, "", "  \n\t ", "Hello world, it's fine.\n\nThe end", "Hello world, it's fine.\n\nThe end", LONG, "a", "ÉTÉ à Paris – 日本語 １２３", "x\u0000y \x1c z", "don't 'll 've''s <|endoftext|> now", "K İ ſ", "\n\n\n", "🙂🙂 ok"]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, and columns whose names operators use inside), with null and repeated ids and rows."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id at all"), (None, None), (7, "another text of seven")]
    extra = "row long, own string, hash long, at int, fp long, ids string, bytes string, score double, words string, block int, rank int, n int, quality int, text_hash long, _row int, _pii_found int"
    names = [c.split()[0] for c in extra.split(", ")]
    filled = [(*r, "en" if r[0] else None, None, len(r[1] or ""), *(None for _ in names)) for r in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
