from __future__ import annotations

import random

import pytest

WORDS = ("the of and to in is that it was for on are as with his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) + str(r.randrange(3)) * (r.random() < 0.05) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and blank and very long texts, copies, near copies, ties, columns with clashing names."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base, "en", "s", 0, "x"), (2, base, "en", "s", 0, "x"), (3, base.replace(" ", "\n"), "en", None, 0, None), (4, near, "en", "s", 0, "x"), (5, None, None, None, None, None), (6, "", "de", "s", 0, "x"),
        (7, " \t\n", None, "s", 0, "x"), (8, prose(2, 9000), "en", "s", 0, "x"), (9, "a" * 30_000, None, "s", 0, "x"), (10, "1234 5678 | ### %%%", "en", "s", 0, "x"), (11, "mail me: jo.do@mail.example.com or +1 (555) 123-4567, 10.0.0.255, 4111 1111 1111 1111", "en", "s", 0, "x"),
        (12, "Der schöne Tag und die Nacht über den Straßen der Stadt, mit der Bahn nach Hause und zurück in das Dorf", "de", "s", 0, "x"), (13, prose(3, 80), "en", "s", 0, "x"), (13, prose(3, 80), "en", "s", 0, "x"), (14, prose(4, 70) + " " + base, "en", "s", 0, "x"), (15, "one", "en", "s", 0, "x"), (16, "One", "en", "s", 0, "x"),
        *[(20 + k, prose(20 + k, 60 + k), "en", "s", 0, "x") for k in range(14)],
        *[(40 + k, " ".join(reversed("Der schöne Tag und die Nacht über den Straßen der Stadt mit Bahn nach Hause zurück Dorf".split()[k:])), "de", "s", 0, "x") for k in range(8)],
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
