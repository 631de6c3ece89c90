"""Brute-force versions that several tests share."""

import collections
import re


def components_of(rows, k=5, t=80):
    """Each doc_id's smallest doc_id reachable by links."""
    sets, holders = {}, collections.defaultdict(list)
    for d, x in rows:
        w = (x or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        for s in sets[d]:
            holders[s].append(d)
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, own in sets.items():
        for o, both in collections.Counter(o for s in own for o in holders[s] if o < d).items():
            if 100 * both >= t * (len(own) + len(sets[o]) - both):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
    return {d: root(d) for d in up}


_M = (1 << 64) - 1


def _mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _M
    return x ^ (x >> 32)


_ODD = [_mix(i) | 1 for i in range(1000, 1032)]


def word_hash(w):
    total, power = len(w) * _ODD[31], 1
    for b in w:
        total += _mix((b + 1) * 0x9E3779B97F4A7C15 & _M) * power
        power = power * 0xB5026F5AA96619E9 & _M
    return _mix(total & _M)


def units_of(x):
    """Units of a text by the plain reading of the rules: (first word, past-last word, start, end, what is compared)."""
    words = [(m[0].encode().lower(), m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", x)]
    h = [word_hash(w) for w, _, _ in words]
    near = [_mix((sum(h[i + k] * _ODD[k] for k in range(3)) + 3) & _M) for i in range(len(h) - 2)]
    stops = {len(words)}
    for i in range(1, len(words)):
        if words[i - 1][0][-1:] in (b".", b"!", b"?") or "\n" in x[words[i - 1][2] : words[i][1]]:
            stops.add(i)
    for i in range(len(near) - 14):  # of 15 in a row the last of the least
        least = min(near[i : i + 15])
        stops.add(max(j for j in range(i, i + 15) if near[j] == least) + 3)
    cuts = sorted(stops - {0})
    return [(a, b, words[a][1], words[b - 1][2], b" ".join(w for w, _, _ in words[a:b])) for a, b in zip([0, *cuts], cuts)]


def repeats_of(rows, least):
    """Runs of units that occur earlier: (doc_id, start, end, words)."""
    units = {d: units_of(x) for d, x in rows if x}
    first, out = {}, []
    for d in sorted(units):
        for n, u in enumerate(units[d]):
            first.setdefault(u[4], (d, n))
    for d in sorted(units):
        run = []
        for n, u in enumerate([*units[d], None]):
            if u is not None and first[u[4]] != (d, n):
                run.append(u)
                continue
            if run and run[-1][1] - run[0][0] >= least:
                out.append((d, run[0][2], run[-1][3], run[-1][1] - run[0][0]))
            run = []
    return out


def cut_repeats_of(rows, least):
    """Each document's text without the runs."""
    runs, out = collections.defaultdict(list), {}
    for d, s, e, _ in repeats_of(rows, least):
        runs[d].append((s, e))
    for d, x in rows:
        for s, e in sorted(runs[d], reverse=True):
            x = x[:s] + x[e:]
        out[d] = x
    return out
