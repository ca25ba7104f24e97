"""Documents with everything that may be odd about them, and plain versions of what the operators share."""

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, key string, score string, fp string, line string, k1 string, copies string, shard string, unit string, found string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def row(doc_id, text, source="s1"):
    """A document whose extra columns have names that operators use inside."""
    return (doc_id, text, "en", source, len(text or ""), *["x"] * 11)


def prose(seed, words, vocabulary=400):
    rnd = random.Random(seed)
    made = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(vocabulary)]
    rnd = random.Random(seed * 7 + words)
    return "\n".join(" ".join(rnd.choice(made) for _ in range(12)) for _ in range(max(1, words // 12)))


def odd_documents():
    base = prose(1, 120)
    edited = base.replace(base.split()[50], "changed", 1)
    long = prose(2, 60_000)
    return [
        row(1, base), row(2, base), row(3, edited, "s2"), row(4, None, None), row(5, "", "s2"), row(6, " \t\n  ", None), row(7, "one"), row(8, "one two"),
        row(9, "ONE two", "é"), row(10, long), row(11, "x" * 70_000, "s3"), row(12, "Über straße 😀 naïve space ab  cd ", "s3"), row(None, base, "s1"),
        row(None, None, None), row(1, base), row(13, prose(3, 300), "Z"), row(14, prose(3, 300) + "\nextra line at the end here", "Z"), row(-5, "a b c d e f", "a"),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


class Groups:
    """Union-find."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
