"""Small tables and brute-force versions for the tests of this folder."""

import hashlib
from collections import Counter

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"

EXTRA = "score double, tid long, key string, g int, text_u string, kept boolean, component long, runs string"
LONG = " ".join(f"w{k % 977} x{k}" for k in range(40_000))


def edge_docs(spark, empty=False):
    """Nulls, empty and long texts, repeated rows, and columns whose names
    clash with the operators' own."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, LONG, "en", "b", len(LONG)),
        (5, "one two three four five six", "de", "b", 27), (5, "one two three four five six", "de", "b", 27),
        (None, "one two three four five six", "de", None, 27), (None, None, None, None, None),
        (6, "Grüße 日本語 😀 \x00 end", "de", "c", 20), (7, "1234 !!! ...", "en", "c", 12)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    rows = [r + (0.5, 1, "k", 2, "u", True, 3, "r") for r in rows]
    return spark.createDataFrame([] if empty else rows, schema)


def removed_by_definition(texts, length=400):
    """doc -> (bytes, removed, runs, sha256 of the rest) by counting every string."""
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                covered[k:k + length] = b"\1" * length
        rest = bytes(c for c, hit in zip(t, covered) if not hit)
        runs = sum(1 for k, hit in enumerate(covered) if hit and (k == 0 or not covered[k - 1]))
        out.append((len(t), sum(covered), runs, hashlib.sha256(rest).hexdigest()))
    return out


def left_by_definition(text, texts, scale):
    """``text`` without the runs covered by strings of ``scale.length`` bytes
    that start elsewhere too, of ``scale.words`` words or more."""
    raw, length = text.encode(), scale.length
    if texts is not getattr(left_by_definition, "texts", None):
        left_by_definition.texts = texts
        left_by_definition.seen = {}
    seen = left_by_definition.seen.get(length)
    if seen is None:
        seen = Counter(t[k:k + length] for t in (x.encode() for x in texts) for k in range(len(t) - length + 1))
        left_by_definition.seen[length] = seen
    covered = bytearray(len(raw))
    for k in range(len(raw) - length + 1):
        if seen[raw[k:k + length]] > 1:
            covered[k:k + length] = b"\1" * length
    rest, k = b"", 0
    while k < len(raw):
        end = k
        while end < len(raw) and covered[end] == covered[k]:
            end += 1
        if not covered[k] or len(raw[k:end].split()) < scale.words:
            rest += raw[k:end]
        k = end
    return rest.decode("utf-8", "ignore")


def shingle_set(text, n=5):
    words = text.split()
    if not words:
        return None
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))}


def classes_by_definition(texts, threshold=0.8):
    """Least index of each text's class under links of Jaccard >= threshold."""
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [shingle_set(t or "") for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]
