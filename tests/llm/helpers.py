"""Plain re-tellings of what the operators compute, for small inputs."""

import collections
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97} and{i}" for i in range(30_000))
#: Columns whose names operators use themselves.
CLASH = ["node", "key", "class_id", "spans", "items", "n_hit", "shard", "size", "rank", "score",
         "lang_pred", "same", "host", "row", "file", "hash", "_base", "label", "found"]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def documents(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """A documents table with clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], schema)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


EDGE_ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "the cat sat on the mat and the dog", "en"),
    (3, "the cat sat on the mat and the dog", "en"), (None, "le chat est sur la table", "fr"),
    (4, LONG, "en"), (5, LONG, "en"), (6, "123 456 !!!", None), (7, "le chat est sur la table", None),
    (-8, "naïve é ß 日本語   x", "fr"), (9, "\u0001\u0002 a\x00b", "en"),
]


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else None


def probability_jaccard(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a.keys() & b.keys())


def classes_by_force(texts):
    """id -> least id linked with it, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for k in s or ():
            by[k].add(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if x == y or (len(x.keys() & y.keys()) > 0.4 * len(x.keys() | y.keys())
                      and probability_jaccard(x, y) >= 0.8):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in texts}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def personal(text):
    """[(start, kind number, end)] of the base kinds."""
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or k == 2 and 12 <= len(digits) <= 19 and luhn(digits)
                    or k == 3 and 9 <= len(digits) <= 15):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def hits_by_force(text, items):
    """(words, words hit, item ids) of one document."""
    own = words(text)
    hit, found = [0] * len(own), set()
    for item, content in items:
        w = words(content)
        if item is None or not w:
            continue
        n = min(len(w), 10)
        for at in range(len(w) - n + 1):
            window = w[at:at + n]
            for i in range(len(own) - n + 1):
                if own[i:i + n] == window:
                    hit[i:i + n] = [1] * n
                    found.add(str(item))
    return len(own), sum(hit), sorted(found)
