"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?:password", "(?i:password"), re.ASCII)


def base_spans(text):
    text = text or ""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    found.sort()
    kinds = [x[3] for x in found]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined.encode()).hexdigest(), joined


def lower_ascii(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_groups(rows, k=4, num=85, den=100):
    """rows: (doc_id, text), ids distinct -> {id: (n, component)}"""
    sets = {d: shingle_set(t, k) for d, t in rows}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    links, seen = [], set()
    for d, s in sets.items():
        for e in {e for x in s for e in by[x] if e > d}:
            both = len(s & sets[e])
            if den * both >= num * len(s | sets[e]):
                links.append((d, e))
    comp = groups(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def contamination(rows, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))

    of = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of[tuple(w[k : k + window])].add("" if i is None else str(i))
    lengths = sorted({len(x) for x in of})
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in of:
                    hit.update(range(k, k + n))
                    found |= of[key]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def token_records(rows, tokenizer, end_id=2):
    """rows with distinct non-null ids."""
    start, out = 0, []
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def near_duplicates(rows, threshold=0.93):
    """rows: (id, vector, label), ids distinct -> {id: (n_links, component, kept)}"""
    ok = []
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((i, np.array(v, dtype=np.float64), label))
    links, n = [], defaultdict(int)
    by = defaultdict(list)
    for i, v, label in ok:
        by[label, len(v)].append((i, v))
    for own in by.values():
        x = np.array([v for _, v in own])
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        s = x @ x.T
        for a in range(len(own)):
            for b in np.flatnonzero(s[a] >= threshold - 1e-12):
                if a != b:
                    n[own[a][0]] += 1
                    if a < b:
                        links.append((own[a][0], own[b][0]))
    comp = groups([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


def entropy_spans(text, window, classes, shapes, words, reach):
    """All spans, base and added, joined as the query joins them."""
    import math

    text = text or ""
    base = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in filter(None, base_spans(text)[4].split(",")))]
    found = list(base)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        word = m[0]
        if not re.search("[0-9]", word) or not re.search("[A-Za-z]", word) or any(re.search(a, word) for a in shapes):
            continue
        name = next(n for n, pattern, _ in classes if re.search(pattern, word))
        bits = next(b for n, _, b in classes if n == name)
        folded = word.lower() if name == "hex" else word
        hot, near = [], [(x.start() - reach, x.end() + reach) for x in re.finditer(words, word)]
        for i in range(len(word) - window + 1):
            if any(i < e and s < i + window for s, e in near):
                continue
            part = folded[i : i + window]
            if -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)) >= bits - 1e-9:
                hot.append(i)
        if hot:
            s, e = m.start() + hot[0], m.start() + hot[-1] + window
            if not any(s < y and x < e for x, _, y in base):
                found.append((s, "entropy", e))
    order = ["assign", "access", "hex", "entropy"]
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], order.index(x[1]), x[2])))


def section_tokens(text, pieces, rule):
    """pieces: bytes of each token in order -> (tokens, crossing, tokens of each line)"""
    line_of, n = [], 0
    for b in (text or "").encode():
        line_of.append(n)
        n += b == 10
    counts, crossing, at = [0] * (line_of[-1] + 1 if line_of else 0), 0, 0
    for p in pieces:
        own = line_of[at : at + len(p)]
        at += len(p)
        crossing += own[0] != own[-1]
        counts[own[0] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
    return len(pieces), crossing, counts


def mixture(rows, slots_of, number, deal, block):
    """rows: (key, source, words, place) -> {key: words taken}; slots_of, deal and number as the operator has them."""
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    packed = {s: [r for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] % 1024, r[3])) for _ in range(r[2])] for s in names}
    sizes = [len(packed[s]) for s in names]
    slots = slots_of(sizes)
    taken = defaultdict(int)
    for row in deal(slots):
        for s, n in enumerate(row):
            done = taken["slots", s]
            for k in range(done, done + n):
                blocks = -(-sizes[s] // block)
                at = number(k, blocks, s) * block
                for r in packed[names[s]][at : at + block]:
                    taken[r[0]] += 1
            taken["slots", s] = done + n
    return {r[0]: taken[r[0]] for r in rows}, sizes


def article(page):
    """The text of the one article of a page as given: blocks parted by a space, white space made one."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li br section blockquote pre table tr td th article figure figcaption hr".split())

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.out = 0, [], []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            text = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            if self.skip or tag in ("script", "style", "aside", "form", "nav", "footer", "header") or re.search(r"\b(comments?|ads?|advert|notice|share|related|sidebar|newsletter|cookie)\b", text):
                if tag not in ("br", "hr", "img", "input", "p", "li"):
                    self.skip.append(tag)
            if tag in self.BLOCKS:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if self.skip and tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            if tag in self.BLOCKS:
                self.out.append("\n")
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.out.append(data.replace("\n", " "))

    r = Reader()
    r.feed(page or "")
    return " ".join(" ".join(line.split()) for line in "".join(r.out).split("\n") if line.split())
