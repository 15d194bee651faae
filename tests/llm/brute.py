"""Plain-Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

from collections import defaultdict

from graphloom.llm.text import reference_words


def repeated_spans(docs: list[tuple[int, str]], least: int = 50) -> set[tuple[int, int, int, int]]:
    """(doc_id, start_word, n_words, first_doc_id), from every window of every document."""
    where = defaultdict(set)
    words = [(i, reference_words(t)) for i, t in docs if i is not None]
    for i, w in words:
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    starts = defaultdict(dict)
    for i, w in words:
        for k in range(len(w) - least + 1):
            have = where[tuple(w[k : k + least])]
            if len(have) > 1:
                starts[i][k] = min(min(have), starts[i].get(k, min(have)))
    out = set()
    for i, at in starts.items():
        run: list[int] = []
        for k in [*sorted(at), None]:
            if run and (k is None or k > run[-1] + least):
                out.add((i, run[0], run[-1] + least - run[0], min(at[x] for x in run)))
                run = []
            run.append(k)
    return out


def shingles(text: str | None, size: int = 3) -> set[tuple]:
    w = reference_words(text)
    size = min(size, len(w)) or 1
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def near_groups(docs: list[tuple[int, str]], alike: float = 0.5) -> dict[int, int]:
    """doc_id -> least doc_id of its group, for documents that have a near copy."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    touched = set()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= alike * max(len(x), len(y)) and len(x & y) >= alike * len(x | y):
                touched |= {a, b}
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in touched}


def longest_common_subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def suffixes(strings: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(string, start, lcp with the one before, symbol before or -1) of all suffixes in order."""
    all_ = sorted((s[k:], n, k) for n, s in enumerate(strings) for k in range(len(s) + 1))
    out, before = [], []
    for tail, n, k in all_:
        lcp = 0
        while lcp < min(len(tail), len(before)) and tail[lcp] == before[lcp]:
            lcp += 1
        out.append((n, k, lcp, strings[n][k - 1] if k else -1))
        before = tail
    return out
