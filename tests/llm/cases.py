"""Small texts with the awkward cases, and brute-force versions of the operators."""

import random

BASE = "the quick brown fox jumps over the lazy dog and runs into the deep forest where old trees stand tall beside a river".split()


def rows(seed: int = 3, n: int = 40) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): copies, near copies, shared passages, short, empty and null texts, repeated rows and a null id."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(70)]
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        body = [word() for _ in range(rng.randint(60, 140))]
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 5) : 55 + rng.randint(0, 15)]
        out.append((1000 - 7 * i, " ".join(body)))
        if i % 3 == 0:
            edited = list(body)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = word()
            out.append((2000 + 3 * i, "\n".join(edited).upper() if i % 2 else "  ".join(edited)))
    out += [(5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "ONE"), (10, "two words"), (11, "two  words"), (None, out[0][1]), (12, out[1][1]), (12, out[1][1])]
    out.append((13, "é " * 3000 + "tail"))
    rng.shuffle(out)
    return out


def frame(spark, data, more: bool = True):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    if not more:
        return df
    return df.selectExpr("doc_id", "text", "1 as id", "'x' as key", "2 as n", "array(1) as ranges", "3 as node", "'h' as component", "5 as extra", "'b' as bucket")


def words(text: str | None, fold: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (bytes(c + 32 if 65 <= c < 91 else c for c in data) if fold else data).split()


def shingles(text: str | None, n: int = 5) -> set:
    w = words(text, fold=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
