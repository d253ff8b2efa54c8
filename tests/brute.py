"""Plain-Python restatements that the tests compare with."""

from __future__ import annotations

from kmerloom.functions.kmers import hash_text


def occurrences(seqs, edges, ref, k, most):
    """(path, p, k-mer) of every occurrence, by extending paths base by base."""
    chosen = set(range(len(seqs))) if ref is None else set(ref)
    found = []

    def walk(path, p, text):
        last = path[-1]
        if len(text) >= k:
            return
        for nxt in edges[last]:
            own = [*path, nxt]
            if sum(v not in chosen for v in own) > most:
                continue
            more = text + seqs[nxt]
            if seqs[nxt] and len(more) >= k:
                found.append((tuple(own), p, more[:k]))
            walk(own, p, more)

    for v, seq in enumerate(seqs):
        if (v not in chosen) > most:
            continue
        for p in range(len(seq)):
            if p + k <= len(seq):
                found.append(((v,), p, seq[p : p + k]))
            else:
                walk([v], p, seq[p:])
    return found


def rows(seqs, edges, ref, k, most, spanning):
    """Sorted (kmer, node_id, start_position, kmer_position)."""
    out = []
    for path, p, kmer in occurrences(seqs, edges, ref, k, most):
        offset = 0
        for i, v in enumerate(path):
            if i == 0 or spanning:
                out.append((hash_text(kmer), v, p if i == 0 else 0, 0 if i == 0 else offset - p))
            offset += len(seqs[v])
    return sorted(out)
