import __spark_entry__ as entry

# The queries of the trace engine that must be there, by family; a family's ids not listed have none yet (see the README).
WANTED = {
    "SRC": "1 2 3 4 5 6 7 8 9 10 11 12 13 14 16 18 19 20 21 22", "SNK": "1 3 6 7 9 10 11 12", "PRJ": " ".join(map(str, range(1, 17))), "JOIN": " ".join(map(str, range(1, 27))), "AGG": " ".join(map(str, range(1, 32))), "WIN": " ".join(map(str, range(1, 14))),
    "SORT": " ".join(map(str, range(1, 9))), "SET": "1 2 3 4 5", "RUL": "1 2 3 4 5 7 9", "SEQ": "1 3 4 5 6 12 13 14 16 17 18", "STC": "1 2 4 5 6 7 8 9 10", "CST": " ".join(map(str, range(1, 10))), "REP": "2 3 4 6 7 8 9 10 11 12 13", "CTX": " ".join(map(str, range(1, 17))), "STR": "1 4 5 6",
    "API": "2 3 6 7 8",
}


def test_registry_is_whole():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {f"{k}-{int(n):02d}" for k, v in WANTED.items() for n in v.split()} <= set(q)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4
