"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring_words(rows, k=20):
    """rows: (doc_id, text) in order; -> doc_id, n_words, n_removed, kept_sha256 by row."""
    split, seen, out = [words(t) for _, t in rows], set(), []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            seen.add(key)
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def substring_bytes(rows, k=50):
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - k + 1):
            first.setdefault(b[i : i + k], d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat), failed


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows, percent=85):
    """doc_id -> (n_shingles, component)"""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def chats(rows):
    """rows: (conv_id, turn, role, text) -> conv_id: (n_turns, turns_sha, loss_chars, loss_sha)"""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def targets(sizes, most=3):
    """sizes: source -> words; targets by sharing again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def greedy_factors(rows, k=20):
    """The greedy parse of each text against the first occurrences of all windows, as runs of words, with the
    longest match at each place and a look at the boundary behind it: (doc, start, length, source, source start)."""
    split = {d: words(t) for d, t in rows}
    first = {}
    for d, w in split.items():
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (d, i))
    runs, where = [], {}
    for d, w in split.items():
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if first[key] == (d, i):
                if runs and runs[-1][0] == d and runs[-1][1] + len(runs[-1][2]) - k + 1 == i:
                    runs[-1][2].append(w[i + k - 1])
                else:
                    runs.append((d, i, list(w[i : i + k])))
                where[key] = (len(runs) - 1, i - runs[-1][1])
    out = []
    for d, w in split.items():
        i = 0
        while i <= len(w) - k:
            key = tuple(w[i : i + k])
            if first[key] == (d, i):
                i += 1
                continue
            run, at = where[key]
            source, begin, text = runs[run]
            n = k
            while i + n < len(w) and at + n < len(text) and w[i + n] == text[at + n]:
                n += 1
            out.append((d, i, n, source, begin + at))
            end = i + n
            i = next((j for j in range(end - k + 1, min(end, len(w) - k + 1)) if first[tuple(w[j : j + k])] != (d, j)), end)
    return out


def gear_chunks(raw, gear, least, normal, most, strict, loose):
    """Chunk ends by a byte-at-a-time gear hash of the last 32 bytes, with the stricter mask up to the normal size."""
    ends, begin = [], 0
    while begin < len(raw):
        end = None
        for at in range(begin, min(len(raw), begin + most)):
            size = at - begin + 1
            if size <= least or len(raw) - begin <= least:
                continue
            h = 0
            for b in raw[max(0, at - 31) : at + 1]:
                h = ((h << 1) + gear[b]) & 0xFFFFFFFF
            if h & (strict if size <= normal else loose) == 0:
                end = at + 1
                break
        begin = end or min(len(raw), begin + most)
        ends.append(begin)
    return ends


def contained(a, ends_a, b, ends_b):
    """Share of a's distinct chunks, by length, that are chunks of b too."""
    cut = lambda raw, ends: {raw[x:y] for x, y in zip([0, *ends[:-1]], ends)} if ends else set()
    x, y = cut(a, ends_a), cut(b, ends_b)
    return sum(len(c) for c in x & y) / sum(map(len, x)) if x else float(not y)


def compression_kept(text, bands):
    """Base rules, the band of the whole text, and no more than a share of its bytes in bad chunks."""
    import zstandard

    raw = (text or "").encode()
    if quality(text)[5]:
        return False
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress(x))

    def fits(x, limits):
        for most, low, high in limits:
            if len(x) <= most:
                return low <= ratio(x) <= high

    pieces = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
    bad = sum(len(x) for x in pieces if not fits(x, bands.chunk))
    return fits(raw, bands.whole) and bad <= bands.chunk_share * len(raw)
