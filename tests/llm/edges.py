"""A small table with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = {"en": ["th", "an", "er", "ing", "on", "ed", "sh", "wh"], "fr": ["eau", "ou", "ai", "ère", "eux", "que"], "de": ["sch", "ung", "ver", "ich", "ä", "pf"]}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def edge_rows(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, sentence(rng, lang, rng.randint(5, 120)), lang, f"s{rng.choice([0, 0, 1, 2])}"))
    body = rows[3][1]
    rows += [
        (1000, None, "en", "s0"), (1001, "", "en", "s1"), (1002, " \n\t ", None, None), (1003, "one", "en", None), (1004, "two words", "fr", "s9"),
        (1005, body, "en", "s0"), (1006, body.upper(), "en", "s0"), (1007, body + " x", "en", "s0"),
        (1008, sentence(rng, "en", 30_000), "en", "s1"), (1009, "  lead  and\u00a0odd\u3000space\t\r\n\n漢字 ½ İ <|endoftext|> it's ", "en", "s2"),
        (1010, "same same same " * 40, "en", "s2"), (1010, "same same same " * 40, "en", "s2"), (1011, "12345 !!! ###", "xx", "s2"),
        (None, "a text without an id at all", "en", "s1"), (None, None, None, None), (1012, "a\x00b \x00c", "de", "s1"),
    ]
    return rows


def edge_frame(spark, n: int = 120, seed: int = 1):
    """``documents`` with extra columns whose names clash with what operators call their outputs."""
    df = spark.createDataFrame(edge_rows(n, seed), "doc_id long, text string, lang string, source string")
    clash = ("id", "fp", "size", "shard", "kept", "key", "score", "start", "tokens", "target", "bucket", "row", "count", "w", "h")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in clash])


def empty_frame(spark):
    return edge_frame(spark, 4).limit(0)
