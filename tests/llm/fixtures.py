"""Small tables with the awkward rows, and brute-force versions of the operators."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, dropped string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstn") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents():
    """Prose, copies, near copies, shared passages, notices, nulls, empty and long texts, repeated rows."""
    base, passage = prose(1, 300), prose(2, 60)
    near = base.split()
    near[150] = "changed"
    texts = [
        base,
        base,
        " ".join(near),
        prose(3, 80) + " " + passage + " " + prose(4, 80),
        prose(5, 50) + "\n" + passage + "\n" + prose(6, 90),
        passage + " " + passage,
        "",
        None,
        " \t\n\x0b\x0c\r ",
        "one",
        "one two",
        "Éé " * 200,
        "ÀB ſtraße K İ ΑΣ don'T <|endoftext|> x\x1cy z 12three",
        prose(7, 30_000),
        "x" * 40_000,
        "The MIT License\nReleased under the MIT License.\ncc by\nAll rights reserved.",
        "### $$$ %%% | a | b | c | d\n" + prose(8, 40) + "\n!!! ### $$$ &&& ***",
    ]
    texts += [f"{prose(100 + i, 25)}\nRead page {i} of this fine notice here.\n{prose(200 + i, 25)}" for i in range(14)]
    rows = [(i, t, "en", ("b", "a", None, "c")[i % 4], len(t or ""), "own size", "own") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[7], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


def words(text):
    return WORD.findall(text or "")


def brute_removed(texts, window=35):
    """Kept words per text after every word in a repeated window is removed."""
    found = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in found for i in range(len(w) - window + 1))
    kept = []
    for w in found:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept.append([x for i, x in enumerate(w) if i not in gone])
    return kept


def shingle_set(text, n=3):
    w = words((text or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def smallest_reachable(ids, linked):
    """Smallest id that links reach, per id."""
    near = defaultdict(set)
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += near[x]
    return out


def brute_components(docs, percent=90):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = [i for i, s in sets.items() if s]
    linked = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both * 100 >= (len(sets[a]) + len(sets[b]) - both) * percent:
                linked.append((a, b))
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, linked).items()}
