"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def bpe(docs):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc, text in docs:
        ids = own.encode_ordinary(text or "")
        yield doc, len(ids), sha(" ".join(map(str, ids))), sha((text or "").encode())


def warc(pages):
    first: dict[bytes, int] = {}
    for page, html in pages:
        key = hashlib.sha1((html or "").encode()).digest()
        if page is not None:
            first[key] = min(page, first.get(key, page))
    for page, html in pages:
        data = (html or "").encode()
        key = hashlib.sha1(data).digest()
        lead = page is None or first[key] == page
        yield (
            page, len(data), base64.b32encode(key).decode(),
            "response" if lead else "revisit", None if lead else first[key],
        )


def nearest(rows, k=5, every=50):
    by_id = {}
    for i, vec in rows:
        if i is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec):
            by_id[i] = min(vec, by_id.get(i, vec))
    for q, a in sorted(by_id.items()):
        if q % every:
            continue
        found = []
        for i, b in by_id.items():
            if i != q and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b))
                found.append((-dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), i))
        for rank, (score, i) in enumerate(sorted(found)[:k], 1):
            yield q, rank, i, -score


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def leaks(docs, items, percent=80):
    def of(text):
        return shingles(re.findall(r"[^\W_]+", (text or "").lower()))

    held = [(i, of(t)) for i, t in items]
    for doc, text in docs:
        own = of(text)
        for item, s in held:
            if s and 100 * len(own & s) >= percent * len(s):
                yield doc, item, len(own & s), len(s)


def chat(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, role or "", text or ""))
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        yield (
            conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said)
        )


def dedup(docs, length=50):
    rows = [(d, (t or "").encode()) for d, t in docs]
    first: dict[bytes, float] = {}
    for doc, data in rows:
        rank = math.inf if doc is None else doc
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(rank, first.get(s, rank))
    for doc, data in rows:
        gone = bytearray(len(data))
        rank = math.inf if doc is None else doc
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < rank:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        yield doc, len(data), sum(gone), runs, sha(kept)


RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def urls(pages, rules=RULES):
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [
            (len(h + p), h + p, v)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host
        ]
        best = max(fits, default=(0, None, "allow"))
        yield page, host, path, best[1], best[2]


def jaccard(docs, percent=80):
    sets = []
    for doc, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        sets.append((doc, shingles(WORD.findall(lowered))))
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    tested = set()
    for rows in where.values():
        for n, i in enumerate(rows):
            for j in rows[n + 1 :]:
                if (i, j) in tested:
                    continue
                tested.add((i, j))
                (a, x), (b, y) = sets[i], sets[j]
                if a is None or b is None:
                    continue
                if 100 * len(x & y) >= percent * len(x | y):
                    a, b = root(a), root(b)
                    parent[max(a, b)] = min(a, b)
    for doc, s in sets:
        yield doc, len(s), None if doc is None else root(doc)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (
            r"[0-9]([\x20-]?[0-9])+",
            lambda v: 12 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
        ),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    )
    found = []
    for kind, (pattern, good) in enumerate(kinds):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(found)


def pii(docs):
    names = ("email", "ip", "card", "phone")
    for doc, text in docs:
        spans = pii_spans(text)
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        yield doc, *counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=10):
    """docs: (id, text); items: (id, text), ids distinct."""
    found = [(d, TERM.findall((t or "").translate(A_TO_Z))) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n_docs, length = len(found), sum(len(w) for _, w in found)
    df = defaultdict(int)
    for _, w in found:
        for t in set(w):
            df[t] += 1
    for item, text in items:
        terms, scores = set(TERM.findall((text or "").translate(A_TO_Z))), []
        for d, w in found:
            m = 10 + 90 * len(w) * n_docs // length
            score = 0
            for t in terms & set(w):
                tf = w.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if d is None else d, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda s: s[:2])[:k], 1):
            yield item, rank, d, -score


def spelling_counts(docs):
    counts = defaultdict(int)
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(counts):
    """(word, form, root, n, n_near, form_n) of words with their counts."""
    form = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = (len(near), best if best and counts[best] >= 5 * n else None)
    for w, n in counts.items():
        root = w
        while form[root][1]:
            root = form[root][1]
        n_near, best = form[w]
        yield w, best, root, n, n_near, counts.get(best)


def simhash(docs, radius=4):
    import xxhash

    prints = []
    for _, text in docs:
        words = WORD.findall((text or "").translate(A_TO_Z))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, near_prints(docs, prints, radius))]


def near_prints(docs, prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def language(rows, texts):
    """(lang, score, known) of texts by counts of all labelled rows (text, lang), none of them cut."""
    import regex

    def words(text):
        return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())

    def grams(word, n):
        marked = f" {word} "
        return [g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g != " "]

    counts, n_grams = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for text, lang in set(rows):
        if text is not None and lang is not None:
            for word in words(text):
                counts[lang][word] += 1
                for n in range(1, 6):
                    for g in grams(word, n):
                        n_grams[lang][g] += 1
    langs = sorted(counts)
    sums = {x: sum(counts[x].values()) for x in langs}
    for text in texts:
        found = words(text)
        if not found or not langs:
            yield "und", 0.0, 0.0
            continue
        score, known = {x: math.log(sums[x] / sum(sums.values())) for x in langs}, 0
        for word in found:
            table, items = counts, [word]
            length = 3
            if not any(word in counts[x] for x in langs):
                table, items = n_grams, []
                for length in (5, 4, 3, 2, 1):
                    items = [g for g in grams(word, length) if any(g in n_grams[x] for x in langs)]
                    if items:
                        break
            known += bool(items) and length >= 3
            for x in langs:
                for item in items:
                    score[x] += math.log((table[x].get(item, 0) + 0.1) / (sums[x] + 1)) / len(items)
        best = max(langs, key=lambda x: (score[x], -langs.index(x)))
        yield best, 1 / sum(math.exp(score[x] - score[best]) for x in langs), known / len(found)
