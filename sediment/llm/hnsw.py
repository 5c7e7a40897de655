"""A hierarchical navigable small-world graph over unit vectors, built and searched many vectors at a time."""

from __future__ import annotations

import io

import numpy as np

#: Nodes in range beyond which a query is compared with all nodes.
MANY = 256


def _top(ids: np.ndarray, sims: np.ndarray, extra: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keep best columns of each row."""
    if sims.shape[1] <= keep:
        return ids, sims, extra
    at = np.argpartition(sims, -keep, axis=1)[:, -keep:]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1), np.take_along_axis(extra, at, 1)


class Graph:
    """links[level] is (nodes, width) with -1 for none; level 0 has twice the width."""

    def __init__(self, vectors: np.ndarray, width: int = 16, beam: int = 64, seed: int = 3):
        self.vectors, self.width, self.beam = np.ascontiguousarray(vectors, "f8"), width, beam
        self.small = self.vectors.astype("f4")  # the way through the graph; links are told by doubles
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(width)).astype("i4"), 6)
        self.levels[: n > 0] = max(self.levels.max(initial=0), 0)  # the first node is on every level
        top = int(self.levels.max(initial=0))
        self.links = [np.full((n, width * (2 if level == 0 else 1)), -1, "i4") for level in range(top + 1)]

    # search ----------------------------------------------------------------------------------
    def search(self, queries: np.ndarray, level: int, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the best nodes met on a level from the entries (queries, any number), best beam of each."""
        rows = np.arange(len(queries))
        seen = np.zeros((len(queries), len(self.small)), bool)
        seen[rows[:, None], np.maximum(entry, 0)] = True
        sims = np.einsum("bed,bd->be", self.small[np.maximum(entry, 0)], queries)
        sims[entry < 0] = -np.inf
        ids, done = entry.copy(), entry < 0
        while len(active := rows[(~done).any(axis=1)]):
            open_sims = np.where(done[active], -np.inf, sims[active])
            take = min(step, open_sims.shape[1])
            pick = np.argpartition(open_sims, -take, axis=1)[:, -take:]
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            flags = done[active]
            np.put_along_axis(flags, pick, True, 1)
            done[active] = flags
            near = self.links[level][np.where(good, ids[active[:, None], pick], 0)]
            near = np.where(good[:, :, None], near, -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            seen[active[:, None], np.where(new, near, ids[active, :1].clip(0))] = True
            got = np.full(near.shape, -np.inf)
            r, c = np.nonzero(new)
            got[r, c] = np.einsum("nd,nd->n", self.small[near[r, c]], queries[active[r]])
            all_ids = np.hstack([ids[active], near])
            all_sims = np.hstack([sims[active], got])
            all_done = np.hstack([done[active], ~new])
            all_ids, all_sims, all_done = _top(all_ids, all_sims, all_done, beam)
            if ids.shape[1] < all_ids.shape[1]:
                pad = all_ids.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, pad)), constant_values=True)
            ids[active], sims[active], done[active] = all_ids, all_sims, all_done
        return ids, sims

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entries for a level: the best few of the level above, from the top down."""
        entry = np.zeros((len(queries), 1), "i4")
        for level in range(len(self.links) - 1, to, -1):
            ids, sims = self.search(queries, level, entry, 4)
            entry = np.where(sims > -np.inf, ids, -1).astype("i4")
        return entry

    # building --------------------------------------------------------------------------------
    def choose(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to width neighbours of each row: those nearer to it than to any neighbour chosen before, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (sims > -np.inf) & (ids >= 0) & (ids != own[:, None])
        chosen = np.full((len(ids), width), -1, "i4")
        count = np.zeros(len(ids), "i4")
        apart = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            rows = np.flatnonzero(valid[:, c] & (count < width // 2))
            if not len(rows):
                continue
            near = self.small[np.maximum(chosen[rows, : width // 2], 0)]
            to = np.einsum("bwd,bd->bw", near, self.small[ids[rows, c]])
            to[chosen[rows, : width // 2] < 0] = -np.inf
            rows = rows[to.max(axis=1) < sims[rows, c]]
            chosen[rows, count[rows]] = ids[rows, c]
            count[rows] += 1
            apart[rows, c] = True
        for c in range(ids.shape[1]):
            rows = np.flatnonzero(valid[:, c] & ~apart[:, c] & (count < width))
            chosen[rows, count[rows]] = ids[rows, c]
            count[rows] += 1
        return chosen

    def _join(self, level: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link new nodes with some of their candidates, both ways."""
        links = self.links[level]
        chosen = self.choose(nodes, ids, sims, links.shape[1])
        links[nodes] = chosen
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, many = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(touched), 2000):
            part, start, n = touched[at : at + 2000], first[at : at + 2000], np.minimum(many[at : at + 2000], 64)
            new = np.full((len(part), int(n.max())), -1, "i4")
            for k in range(new.shape[1]):
                rows = n > k
                new[rows, k] = source[start[rows] + k]
            both = np.hstack([links[part], new])
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.einsum("bcd,bd->bc", self.small[np.maximum(both, 0)], self.small[part])
            near[both < 0] = -np.inf
            links[part] = self.choose(part, both, near, links.shape[1])

    def build(self) -> Graph:
        n, done = len(self.small), 1
        while done < n:
            nodes = np.arange(done, min(n, done + min(512, max(32, done))))
            entry = self.descend(self.small[nodes], len(self.links) - 1)
            for level in range(len(self.links) - 1, -1, -1):
                if level < len(self.links) - 1:
                    entry = np.where(sims > -np.inf, ids, -1)[:, : self.beam].astype("i4")
                ids, sims = self.search(self.small[nodes], level, entry, self.beam)
                mine = np.flatnonzero(self.levels[nodes] >= level)
                if not len(mine):
                    continue
                batch = nodes[mine]
                with_batch = self.small[batch] @ self.small[batch].T
                np.fill_diagonal(with_batch, -np.inf)
                all_ids = np.hstack([ids[mine], np.broadcast_to(batch, with_batch.shape).astype("i4")])
                all_sims = np.hstack([sims[mine], with_batch])
                all_ids, all_sims, _ = _top(all_ids, all_sims, all_sims, self.beam)
                self._join(level, batch, all_ids, all_sims)
            done = int(nodes[-1]) + 1
        return self

    # range search ----------------------------------------------------------------------------
    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """The nodes of cosine least or more that a beam finds, and all that are reached from them over such nodes.

        Where they are very many, all nodes are compared instead.
        """
        none = np.zeros(0, "i8")
        out = [none] * len(queries)
        for at in range(0, len(queries), 512):
            part = queries[at : at + 512]
            quick = part.astype("f4")
            ids, sims = self.search(quick, 0, self.descend(quick, 0), beam)
            hopeful = sims >= least - 1e-4
            for row in np.flatnonzero(hopeful.any(axis=1)).tolist():
                q, found = part[row], np.unique(ids[row, hopeful[row]])
                found = found[self.vectors[found] @ q >= least]
                fresh = found
                while len(fresh):
                    if len(found) > MANY:
                        found = np.flatnonzero(self.vectors @ q >= least)
                        break
                    near = np.unique(self.links[0][fresh])
                    near = np.setdiff1d(near[near >= 0], found, assume_unique=True)
                    fresh = near[self.vectors[near] @ q >= least]
                    found = np.union1d(found, fresh)
                out[at + row] = found.astype("i8")
        return out

    def to_bytes(self, **more: np.ndarray) -> bytes:
        """The graph and more arrays, in one piece."""
        buffer = io.BytesIO()
        links = {f"links{k}": x for k, x in enumerate(self.links)}
        np.savez(buffer, vectors=self.vectors, levels=self.levels, shape=np.array([self.width, self.beam]), **links, **more)
        return buffer.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as stored:
            got = dict(stored)
        out = cls.__new__(cls)
        out.vectors, out.levels = got.pop("vectors"), got.pop("levels")
        out.small = out.vectors.astype("f4")
        out.width, out.beam = (int(x) for x in got.pop("shape"))
        out.links = [got.pop(f"links{k}") for k in range(sum(name.startswith("links") for name in got))]
        return out, got
