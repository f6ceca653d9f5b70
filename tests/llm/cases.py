"""Documents that every operator must take: nulls, empty, blank and long texts, repeats, ties, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("w%x" % (hash_(r.randrange(vocabulary)) % 5003) for _ in range(n))


def hash_(x: int) -> int:
    return (x * 2654435761 + 97) % (1 << 32)


def documents() -> list[tuple]:
    """doc_id, text, lang, source, and columns whose names operators use themselves."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "edited"
    texts = [
        base,
        base,  # an exact copy
        " ".join(near),
        base.upper() + "\n",  # case and white space don't tell texts apart
        prose(2, 80),
        prose(3, 12),
        "one two three",
        "One  two\tthree ",
        "one two four",
        "",
        " \t\n\x0b\x0c\r ",
        None,
        "1234 5678 -- !!",
        prose(4, 6000, 3000),  # long
        "é" * 3000 + " ñandú ß 漢字 привет мир",
        "x" * 70000,  # one very long word
        "zero\x00width​ joiner‍ \U0001f600 \u0085 next",
    ]
    sources = ["a", "b", None, "a"]
    rows = [(i, t, ["en", "de", None][i % 3], sources[i % 4], None if t is None else len(t), 0.5, i, 7) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a whole row again
    rows.append((None, prose(2, 80), "en", "a", 1, None, None, None))  # no id
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def words(text):
    """The contract's words, with A-Z lower-cased."""
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)
