"""Small tables with every awkward row, and plain versions of the operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, n_words string, shingle string"


def documents(spark, texts):
    """Rows (doc_id, text) with columns whose names operators also use."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, "x", None) for i, t in texts], DOCS)


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared lines, repeats, nulls, blanks and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 5)))
    line = lambda: " ".join(word() for _ in range(r.randrange(4, 12)))
    shared = [line() for _ in range(6)]
    texts = []
    for _ in range(n):
        lines = [line() for _ in range(r.randrange(1, 9))]
        if r.random() < 0.4:
            at = r.randrange(len(lines) + 1)
            lines[at:at] = shared[:3] if r.random() < 0.5 else shared[1:6]
        texts.append("\n".join(lines))
    for k in range(8):  # near copies
        words = texts[k].split(" ")
        for _ in range(k % 3):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], "A b", "a B", "one", "", "", " \n\t ", None, None, "x\n" * 9, "same same " * 60, " ".join(word() for _ in range(3000))]
    rows = list(enumerate(texts))
    return rows + [(None, "no id here at all"), (5, texts[5]), (6, "another text under an id that is taken")]


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", ascii_lower(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
