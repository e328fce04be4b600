"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        masked = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(masked), sha(masked))
    return out


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = lower(host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def shape(path, depth=8):
    segments = (path[1:] if path.startswith("/") else path).split("/")
    if len(segments) > depth:
        segments = [*segments[: depth - 1], "/".join(segments[depth - 1 :])]
    out = []
    for s in segments:
        if re.fullmatch(r"(?=.*[0-9])[0-9a-fA-F-]{8,}", s):
            out.append("{id}")
        else:
            out.append(re.sub("[0-9]+", "{n}", s.translate({123: "(", 125: ")"})))
    return tuple(out)


def templates(rows, min_children=16, max_share=0.05, z=2.0, smoothing=4.0, prior=0.25):
    """rows: (host, shape, bad or None); (host, shape) -> (template, purity), node by node."""
    leaves = {}
    for host, shape_, bad in rows:
        leaf = leaves.setdefault((host, shape_), [0, 0, 0])
        leaf[0] += 1
        leaf[1] += bad is not None
        leaf[2] += bad or 0
    out = {}

    def total(keys):
        return [sum(leaves[k][i] for k in keys) for i in range(3)]

    def visit(keys, level, template, base):
        n, labelled, bad = total(keys)
        purity = (bad + smoothing * base) / (labelled + smoothing)
        children, following = defaultdict(list), Counter()
        for k in keys:
            if len(k[1]) <= level:
                out[k] = (template, purity)
            else:
                children[k[1][level]].append(k)
        after = lambda k: k[1][level + 1] if len(k[1]) > level + 1 else "{end}"
        inner = [k for own in children.values() for k in own]
        for k in inner:
            following[after(k)] += leaves[k][0]
        all_n, all_labelled, all_bad = total(inner)
        rate = (all_bad + 0.5) / (all_labelled + 1)
        branch = {}
        for name, own in children.items():
            cn, cl, cb = total(own)
            alike = cl == 0 or abs(cb / cl - rate) <= z * math.sqrt(rate * (1 - rate) / cl) + 1e-9
            cells = Counter()
            for k in own:
                cells[after(k)] += leaves[k][0]
            chi = sum((cells[x] - cn * following[x] / all_n) ** 2 / (cn * following[x] / all_n) for x in following)
            if alike and len(children) >= min_children and cn <= max_share * all_n:
                branch[name] = "{*}"
            elif alike and chi <= len(following) - 1 + z * math.sqrt(2 * max(len(following) - 1, 1)) + 1e-9:
                branch[name] = "{~}"
        members = Counter(branch.values())
        grouped = defaultdict(list)
        for name, own in children.items():
            grouped[branch[name] if members[branch.get(name)] > 1 else name] += own
        for name, own in grouped.items():
            _, cl, cb = total(own)
            visit(own, level + 1, f"{template}/{name}", (bad - cb + smoothing * base) / (labelled - cl + smoothing))

    by = defaultdict(list)
    for k in leaves:
        by[k[0]].append(k)
    for keys in by.values():
        visit(keys, 0, "", prior)
    return out


KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, pattern, group, least) in enumerate(KINDS) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    counts = Counter(f[3] for f in found)
    return counts["assign"], counts["access"], counts["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)))


def repeats(docs, depth=50):
    """docs: (doc_id, text); one row of each."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w not in first or i < first[w]:
                first[w] = i
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < i:
                gone[p : p + depth] = b"\1" * depth
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def kneser_ney(texts, order=5, universe=0x110000):
    """A function from a text to its mean negative log probability by character, by plain dictionaries."""
    padded = ["\0" * (order - 1) + t.replace("\0", "\1") for t in texts]
    counts = {order: Counter(t[i - order + 1 : i + 1] for t in padded for i in range(order - 1, len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p, gamma = {0: {"": 1 / universe}}, {}
    for k in range(1, order + 1):
        of = [max(sum(c == i for c in counts[k].values()), 1) for i in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3) - 1]
        gamma[k] = {x: cut[x] / total[x] for x in total}
        p[k] = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] + gamma[k][g[:-1]] * p[k - 1][g[1:]] for g, c in counts[k].items()}

    def score(text):
        t, out = "\0" * (order - 1) + text.replace("\0", "\1"), 0.0
        for i in range(order - 1, len(t)):
            for k in range(order, -1, -1):
                g = t[i - k + 1 : i + 1]
                if g in p[k]:
                    out += math.log(p[k][g])
                    break
                out += math.log(gamma[k].get(g[:-1], 1)) if k else math.log(1 / universe)
        return -out / max(len(text), 1)

    return score


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, percent):
    """Pairs by an index of tokens, then union-find."""
    sets = {i: shingles(t, k) for i, t in docs}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        common = Counter(b for x in sets[a] for b in index[x] if b > a)
        for b, c in common.items():
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def token_ids(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(docs, rows, tokenizer, window=4096):
    """Raises unless the pieces are exactly the documents' ids; returns padding and tokens."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs:
        ids = token_ids(text, tokenizer)
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids), r
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), r
            at += r["length"]
        assert at == len(ids), i
    padding = total = 0
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= window
        total += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding, total


def token_sections(text, encoding, starts, rule):
    """(n_tokens, n_crossing) of each section, token by token and character by character."""
    raw, owner = (text or "").encode(), []
    for i, c in enumerate(text or ""):
        owner += [i] * len(c.encode())
    section = lambda i: max(k for k, s in enumerate(starts) if s <= i)
    counts, at = [[0, 0] for _ in starts], 0
    for token in encoding.encode_ordinary(text or ""):
        width = len(encoding.decode_single_token_bytes(token))
        chars = sorted(set(owner[at : at + width]))
        at += width
        held = Counter(section(i) for i in chars)
        to = {"start": section(chars[0]), "end": section(chars[-1]), "majority": min(held, key=lambda k: (-held[k], k))}[rule]
        counts[to][0] += 1
        counts[to][1] += len(held) > 1
    assert at == len(raw)
    return [tuple(x) for x in counts]
