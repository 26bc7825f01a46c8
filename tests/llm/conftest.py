import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def prose(seed, n):
    """Words from a small generator: the same seed gives the same text."""
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(seed >> 33) % len(WORDS)] + str((seed >> 40) % 97))
    return out


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, one id twice, and clashing extra columns."""
    long_text = " ".join(prose(7, 9000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, " ".join(prose(1, 60))),
        (7, " ".join(prose(1, 60))), (8, " ".join(prose(1, 60)) + " end"), (8, "another text"), (9, "same row"), (9, "same row"),
        (10, long_text), (11, "x" * 20_000), (12, " ".join([*prose(2, 40), *prose(3, 50)])), (13, " ".join([*prose(4, 30), *prose(3, 50)])),
        (-5, "negative id " + " ".join(prose(5, 30))), (None, "no id"), (14, "é ü ß 漢字 \U0001f600 \x85 end"),
        (15, "call +1 (068) 555-2713 or a.b@c.example.org from 10.0.0.300 and 10.0.0.30, card 4539 1488 0343 6467"),
    ]
    # Names that the operators use themselves, with and without a line.
    clashing = ["mark", "n", "class", "score", "_mark", "_slot", "slot", "_text", "spans", "_spans", "base", "row", "_key_id", "key_id", "start", "value", "kind", "words", "found"]
    wide = [(i, t, "en" if i != 4 else None, "s", 0, *["a"] * len(clashing)) for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
