import pytest
from pyspark.sql import functions as F

from sightline.functions.location import compile_filter_column, location_match

CASES = [
    ("Madrid", "Madrid, Spain", True),
    ("Madrid", "MADRID", True),
    ("Madrid", "España", True),
    ("Madrid", "Remote in Spain", True),
    ("Madrid", "Sevilla, Spain", False),          # another peer city
    ("Madrid", "Madrid / Barcelona", False),      # a peer rejects before Madrid accepts
    ("Madrid", "Santander CIB, Madrid", False),   # a firm's name is a peer city
    ("Madrid", "Madridejos", True),               # filter name as a substring, last of all
    ("Madrid", "Las Palmas, Spain", False),       # phrase as substring
    ("Madrid", "San Sebastián, España", False),
    ("Madrid", "Glasgow, United Kingdom", False),
    ("Madrid", "Leon, Spain", False),
    ("Madrid", "Leonesa, Spain", True),           # no word of its own
    ("London", "London, New York", False),        # york is a peer
    ("London", "u.k.", False),                    # never matches: tokens have no dots
    ("London", "UK", True),
    ("London", "Great Britain", True),
    ("London", "Milton Keynes, UK", False),
    ("Sevilla", "Seville, Spain", False),         # the alias is also a peer
    ("Sevilla", "Spain", True),
    ("Madrid|London", "London", True),
    ("Madrid, London", "Madrid or London", True),
    ("Madrid, London", "Barcelona", False),
    ("New York", "new york city", True),
    ("New York", "York", False),
    ("Madrid", "", False),
    ("Madrid", None, False),
    ("León, Spain", "León", True),
    (" Madrid", "Madrid", False),                 # the blank at the end of a filter stays
]


@pytest.mark.parametrize("how", ["literal", "column"])
def test_cases(spark, column, how):
    if how == "column":
        got = column(
            [(f, t) for f, t, _ in CASES], "f string, t string",
            location_match(F.col("t"), compile_filter_column(F.col("f"))),
        )
        assert got == [e for *_, e in CASES]
        return
    for places in {f for f, *_ in CASES}:
        some = [(t, e) for f, t, e in CASES if f == places]
        got = column([(t,) for t, _ in some], "t string", location_match(F.col("t"), places))
        assert got == [e for _, e in some], places
