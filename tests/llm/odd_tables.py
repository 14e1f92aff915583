"""Small tables with the cases that every operator has to handle."""

import random

LETTERS = "bdfglmnprst"


def word(rng):
    return "".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))


def prose(rng, n, vocabulary=None):
    pick = (lambda: rng.choice(vocabulary)) if vocabulary else (lambda: word(rng))
    return " ".join(pick() + rng.choice(("", "", "", ",", ".")) for _ in range(n))


def texts(seed=5, n=40):
    """Prose with copies, near copies, shared passages, blanks and one long text."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    out = [prose(rng, rng.randint(5, 160)) for _ in range(n)]
    for k in range(0, n, 5):
        out.append(out[k])
        words = out[k].split()
        words[len(words) // 2] = "anders"
        out.append(" ".join(words))
        out.append(f"{prose(rng, 30)}\n{shared}\t{prose(rng, 20)}")
    out += ["", " \t\n", "Kurz", "zwei WORTE", "a\x0bb\x0cc\rd e", "übermäßig ÄÖ x y \x1cz",
            "na " * 500, prose(rng, 6000)]
    return out


SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "key string, score double, size int, fp string, n_words string")


def rows(seed=5, n=40):
    out = [(k, t, "en" if k % 3 else None, f"src{k % 4}", len(t), "k", 0.5, 3, "f", "w")
           for k, t in enumerate(texts(seed, n))]
    out.append((900, None, "en", "src0", None, None, None, None, None, None))
    out.append((None, "ohne Nummer aber mit Text und noch ein paar Worten hier dazu", None, None, 1, "", 0.0, 0, "", ""))
    out.append((None, None, None, None, None, None, None, None, None, None))
    out.append(out[3])
    return out


def documents(spark, seed=5, n=40, parts=3):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    """Words as the rules name them, told by a pattern instead of ``bytes.split``."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
