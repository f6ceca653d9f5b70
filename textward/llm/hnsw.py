"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries at once.

Nodes stand in descending order of level, so layer l is a prefix of them. Layers are built from
the top; a batch of nodes finds its neighbours by a beam search from the nearest nodes of the layer
above, and among itself. A node keeps neighbours that are nearer to it than to each other, then
the nearest others.
"""

from __future__ import annotations

import numpy as np

M = 16
BUILD_BEAM = 32
BATCH = 512
STEP = 4


def levels(n: int) -> np.ndarray:
    """Number of nodes on each layer: a sixteenth of the layer below, down to a few."""
    out = [n]
    while out[-1] > 4 * M:
        out.append(-(-out[-1] // M))
    return np.array(out)


def _sims(vecs: np.ndarray, node: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vecs[node], q[row])


def _pad(row: np.ndarray, values: tuple[np.ndarray, ...], n: int, fill: tuple) -> list[np.ndarray]:
    """Flat values with ascending row numbers as [n, most per row] arrays."""
    count = np.bincount(row, minlength=n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for v, f in zip(values, fill, strict=True):
        a = np.full((n, max(int(count.max(initial=0)), 1)), f, v.dtype)
        a[row, at] = v
        out.append(a)
    return out


def _distinct(row: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order; node < n."""
    flat = row * np.int64(n) + node
    flat.sort()
    flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))] if len(flat) else flat
    return np.divmod(flat, n)


def beam(vecs: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities [len(q), width], best first, of nodes near each query (-1 where fewer are reached)."""
    n_q, n = len(q), len(links)
    seen = np.zeros((n_q, n), bool)
    ids = np.full((n_q, width), -1, np.int64)
    sim = np.full((n_q, width), -np.inf, np.float32)
    done = np.ones((n_q, width), bool)
    live = np.arange(n_q)
    row, node = np.repeat(np.arange(n_q), entry.shape[1]), entry.ravel()
    row, node = row[node >= 0], node[node >= 0]
    while len(live):
        new = ~seen[live[row], node]  # row: number in live
        row, node = _distinct(row[new], node[new], n)
        seen[live[row], node] = True
        found = _sims(vecs, node, q, live[row])
        better = found > sim[live[row], -1]
        more_ids, more_sim = _pad(row[better], (node[better], found[better]), len(live), (-1, np.float32(-np.inf)))
        all_ids = np.concatenate([ids[live], more_ids], axis=1)
        all_sim = np.concatenate([sim[live], more_sim], axis=1)
        all_done = np.concatenate([done[live], more_ids < 0], axis=1)
        best = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sim[live] = np.take_along_axis(all_sim, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
        # the STEP best nodes of each beam that aren't expanded yet
        rank = np.cumsum(~done[live], axis=1)
        r, c = np.nonzero(~done[live] & (rank <= STEP))
        done[live[r], c] = True
        keep, r = np.unique(r, return_inverse=True)
        chosen = ids[live[keep][r], c]
        live = live[keep]
        row = np.repeat(r, links.shape[1])
        node = links[chosen].astype(np.int64).ravel()
        row, node = row[node >= 0], node[node >= 0]
    return ids, sim


def _choose(vecs: np.ndarray, centre: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """[rows, m] neighbours out of the candidates [rows, k] of each centre (-1: none)."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == centre[:, None]] = -1
    x = vecs[np.maximum(cand, 0)]
    sim = np.where(cand >= 0, np.einsum("rkd,rd->rk", x, vecs[centre]), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")[:, : m + M]  # the farthest ones hardly ever matter
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    x = vecs[np.maximum(cand, 0)]
    among = x @ x.transpose(0, 2, 1)
    rows, k = cand.shape
    taken = np.zeros((rows, k), bool)
    nearest = np.full((rows, k), -np.inf, np.float32)  # similarity to the nearest one taken
    for j in range(k):
        ok = (cand[:, j] >= 0) & (sim[:, j] >= nearest[:, j]) & (taken.sum(axis=1) < m)
        taken[:, j] = ok
        nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j]), nearest)
    place = np.argsort(np.where(cand < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(cand, place, 1)


def _connect(vecs: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    m = links.shape[1]
    links[new, : chosen.shape[1]] = chosen
    of, to = np.repeat(new, chosen.shape[1]), chosen.ravel()
    of, to = of[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    of, to = of[order], to[order]
    back = np.unique(to)
    row = np.searchsorted(back, to)
    count = np.bincount(row, minlength=len(back))
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    for start in range(0, int(count.max(initial=0)), m):  # rounds of at most m new links a node
        here = (at >= start) & (at < start + m)
        nodes, r = np.unique(row[here], return_inverse=True)
        extra = np.full((len(nodes), m), -1, np.int64)
        extra[r, at[here] - start] = of[here]
        for a in range(0, len(nodes), BATCH):
            part = back[nodes[a : a + BATCH]]
            have = links[part].astype(np.int64)
            got = _choose(vecs, part, np.concatenate([have, extra[a : a + BATCH]], axis=1), m)
            links[part, : got.shape[1]] = got


def build(vecs: np.ndarray) -> list[np.ndarray]:
    """links[l]: int32[nodes of layer l, neighbours]; vecs: float32 unit vectors."""
    sizes = levels(len(vecs))
    layers: list[np.ndarray] = [None] * len(sizes)
    for layer in range(len(sizes) - 1, -1, -1):
        n = int(sizes[layer])
        links = np.full((n, 2 * M if layer == 0 else M), -1, np.int32)
        at = 0
        while at < n:
            # a batch is no larger than what is there to be searched
            end = min(n, at + max(4 * M, min(BATCH, at)))
            new = np.arange(at, end)
            among = vecs[new] @ vecs[new].T
            np.fill_diagonal(among, -np.inf)
            k = min(M, len(new) - 1)
            cand = new[np.argpartition(-among, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(new), 1), -1)
            if at:
                entry = enter(vecs, layers[layer + 1 :], vecs[new]) if layer + 1 < len(sizes) else np.zeros((len(new), 1), np.int64)
                entry = np.where(entry < at, entry, 0)
                found, _ = beam(vecs, links[:at], vecs[new], entry, BUILD_BEAM)
                cand = np.concatenate([cand, found], axis=1)
            _connect(vecs, links, new, _choose(vecs, new, cand.astype(np.int64), M))
            at = end
        layers[layer] = links
    return layers


def enter(vecs: np.ndarray, upper: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Entry nodes [len(q), few] for the layer below `upper`, found from its top down."""
    entry = np.zeros((len(q), 1), np.int64)
    for links in reversed(upper):
        entry, _ = beam(vecs, links, q, entry, STEP)
    return entry[:, :4]


def within(vecs: np.ndarray, layers: list[np.ndarray], q: np.ndarray, least: float, width: int, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs found with similarity >= least, flat.

    A beam of the given width; where it ends among near nodes, all nodes reached from there over
    nodes of similarity least - slack are added, so a beam doesn't bound the number found.
    """
    links = layers[0]
    n = len(links)
    ids, sim = beam(vecs, links, q, enter(vecs, layers[1:], q), width)
    near = sim >= least - slack
    row, col = np.nonzero(near)
    out_row, out_node = row, ids[row, col]
    out_sim = sim[row, col]
    full = np.flatnonzero(near.sum(axis=1) >= width // 2)
    if len(full):
        pos = np.full(len(q), -1)
        pos[full] = np.arange(len(full))
        mine = pos[row] >= 0
        seen = np.zeros((len(full), n), bool)
        r, node = pos[row[mine]], out_node[mine]
        seen[r, node] = True
        rows, nodes, sims = [out_row], [out_node], [out_sim]
        while len(r):
            next_r = np.repeat(r, links.shape[1])
            next_n = links[node].astype(np.int64).ravel()
            ok = next_n >= 0
            next_r, next_n = next_r[ok], next_n[ok]
            ok = ~seen[next_r, next_n]
            next_r, next_n = _distinct(next_r[ok], next_n[ok], n)
            seen[next_r, next_n] = True
            s = _sims(vecs, next_n, q, full[next_r])
            ok = s >= least - slack
            r, node = next_r[ok], next_n[ok]
            rows.append(full[r])
            nodes.append(node)
            sims.append(s[ok])
        out_row, out_node, out_sim = map(np.concatenate, (rows, nodes, sims))
    ok = out_sim >= least - 1e-4  # float32: the caller verifies
    return out_row[ok], out_node[ok]
