"""Plain Python versions of the operators, straight from their contracts."""

import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return text.encode().lower().decode()


def suffix_dedup(docs, n=100):
    """docs in order: (doc_id, text)."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            s = raw[i:i + n]
            if s in seen:
                gone[i:i + n] = b"\1" * n
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def license_base(docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        hits = [(i, name) for p, name in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        places = [i for i, _ in hits]
        out.append((doc_id, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def license_labels(docs, scan):
    """{doc_id: (labels, score)} with every template of the module tried at every place; base phrases as in license_base."""
    split = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))) for d, t in docs]
    weights = {w: round(math.log((len(docs) + 1) / (sum(w in words for _, words in split) + 1)) + 0.01, 6) for w in scan.VOCABULARY}
    base = {d: names for d, *_, names in license_base(docs)}
    out = {}
    for d, words in split:
        labels, score = set(base[d].split(",")) - {""}, scan.BASE_SCORE if base[d] else 0.0
        for label, notice, key in scan.TEMPLATES:
            parts = notice.split()
            rare = sorted(set(parts), key=lambda w: (-weights[w], w))[:min(8, max(2, (len(set(parts)) + 1) // 2))]
            for shift in range(1 - len(parts), len(words)):
                here = dict(enumerate(words[max(shift, 0):shift + len(parts)], max(shift, 0)))
                if sum(w in rare and here.get(shift + p) == w for p, w in enumerate(parts)) < 2:
                    continue
                line = " " + " ".join(words[max(shift - 3, 0):shift + len(parts) + 3]) + " "
                if f" {key} " not in line or any(f" {no} {key} " in line for no in ("not", "never", "nor")):
                    continue
                held = sum((weights[w] for p, w in enumerate(parts) if w in words[max(shift + p - 3, 0):max(shift + p + 4, 0)]), 0.0)
                share = min(round(held / sum(weights[w] for w in parts), 6), 1.0)
                if share >= scan.MIN_SHARE:
                    labels.add(label)
                    score = max(score, share)
        out[d] = (",".join(sorted(labels)), score)
    return out


def token_files(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in docs]
    return [(*r, r[2] > 1024) for r in rows]


def byte_bpe(docs, ranks):
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc_id, text in docs:
        ids = t.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode_bytes(ids))))
    return out


def exact_dedup(docs):
    """docs with distinct ids."""
    groups = collections.defaultdict(list)
    for doc_id, text in docs:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    best = {k: min(v)[2] for k, v in groups.items()}
    return [(d, best[k], len(groups[k]), d == best[k], sha(k)) for d, x in docs for k in [SPACE.sub("", x or "")]]


def mix_targets(docs):
    """(source, text) -> {source: (size, target)} by resharing until nothing is above its limit."""
    sizes = collections.Counter()
    for source, text in docs:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return {s: (sizes[s], target[s]) for s in names}


def quality_base(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
                    len(words) < 10 or 100 * len(covered) > 20 * len(words)))
    return out


def fingerprint(text, words=3):
    w = lower(text or "").encode().split()
    runs = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = [fingerprint(x) for _, x in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [(d, f"{p:016x}", min(x for x in least[find(i)] if x is not None)) for i, ((d, _), p) in enumerate(zip(docs, prints))]


def pii_base(docs):
    out = []
    for doc_id, text in docs:
        text, spans = text or "", []
        digits = lambda m: re.sub("[^0-9]", "", m)

        def luhn(d):
            return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

        kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
                 ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
                 ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
                 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))
        for order, (kind, pattern, ok) in enumerate(kinds):
            spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
        names = [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]
        count = collections.Counter(k for _, _, k, _ in spans)
        out.append((doc_id, *(count[k[0]] for k in kinds), sha(",".join(names)), names))
    return out


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(docs):
    """(doc_id, n, form, prefix_chars, middle_chars, output, text)"""
    out = []
    for doc_id, text in docs:
        text = text or ""
        digest = sha(f"42:{'null' if doc_id is None else doc_id}")
        h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
        units = UNIT.findall(text)
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((doc_id, len(units), "plain", None, None, text, text))
        elif h[3] % 100 < 80:
            out.append((doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text))
        else:
            out.append((doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text))
    return out


def document_ids(docs, end_id):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end_id]) for d, x in docs]


FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = FEATURE_WORD.findall(lower(text or ""))
    return [zlib.crc32(w.encode()) % 10000 for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def importance_sample(docs, target):
    """(doc_id, n_features, weight, score, rank) in the order of the input; doc_ids that repeat tie in that order."""
    s, t = collections.Counter(), collections.Counter()
    found = [(d, *features(x)) for d, x in docs]
    for _, f, _ in found:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for d, f, n in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'null' if d is None else d}")[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:25 * len(fit) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]
