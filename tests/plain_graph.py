"""The concept graph of one document in plain Python, for tests: units, relations and siblings one after another."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lectern.functions.caps import within_degree
from lectern.functions.vocab import EDGE_PRIORITY
from lectern.operators.concept_graph import LOCAL, MODES, MODES_ELSE, OWNER, PROMINENCE, TYPE_BONUS, mode_fits
from lectern.operators.graph import by_number, within


def norm(name):
    return re.sub(r"\s+", " ", (name or "").lower().strip().replace("-", " "))


def tokens(name):
    return frozenset(t.rstrip("s") if len(t) > 3 else t for t in re.findall(r"\w+", norm(name)))


def match_score(value: str | None, target: str, scores: tuple[int, int, int]) -> int:
    v, t = norm(value), norm(target)
    if not v or not t:
        return 0
    if v == t:
        return scores[0]
    a, b = tokens(v), tokens(t)
    shared = len(a & b)
    if not shared:
        return 0
    return scores[1] + min(12, 3 * shared) if within(a, b) else scores[2] + min(18, 4 * shared)


@dataclass
class Graph:
    """A document's graph as it grows."""

    units: dict[str, dict]
    near: dict[str, list[str]] = field(default_factory=dict)
    kind: dict[tuple[str, str], str] = field(default_factory=dict)
    index: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.near = {k: [] for k in self.units}
        self.fixed: dict[tuple[str, str], tuple[int, int, int]] = {}
        for k, u in self.units.items():
            for f in ("concept", "local_concept", "owner_concept", "parent_l1", "parent_l2"):
                if norm(u[f]) and k not in self.index.setdefault(norm(u[f]), []):
                    self.index[norm(u[f])].append(k)

    def owner(self, k: str) -> str:
        return norm(self.units[k]["owner_concept"] or self.units[k]["parent_l2"])

    def alike(self, a: str, b: str) -> bool:
        if self.owner(a) and self.owner(b) and self.owner(a) != self.owner(b):
            return False
        return norm(self.units[a]["concept"]) == norm(self.units[b]["concept"]) != ""

    def score(self, k: str, name: str, relation: str) -> tuple[int, int, int]:
        """Total, local and owner score of a unit for a name; all but the degree is computed once for each name."""
        if (k, name) not in self.fixed:
            u = self.units[k]
            local, own = (max(match_score(u[f], name, s) for f, s in table.items()) for table in (LOCAL, OWNER))
            n = len(re.findall(r"\w+", u["verbatim_evidence"] or ""))
            rest = PROMINENCE.get(u["prominence"], (0, 2))[0] + (-5 if n < 6 else min(8, n // 10))
            if name and not local:
                rest -= 18 if own else 40
            self.fixed[k, name] = (local + own + rest, local, own)
        base, local, own = self.fixed[k, name]
        return base + TYPE_BONUS.get(relation, {}).get(self.units[k]["type"], 0) + 2 * min(len(self.near[k]), 3), local, own

    def ranked(self, ids: list[str], name: str, relation: str = "") -> list[str]:
        place = lambda k: (*(-x for x in self.score(k, name, relation)), PROMINENCE.get(self.units[k]["prominence"], (0, 2))[1], k)
        return sorted(dict.fromkeys(ids), key=place)

    def resolved(self, name: str, relation: str, most: int) -> list[str]:
        ids = self.index.get(norm(name))
        if not ids:
            q = tokens(name)
            ids = [k for key, own in self.index.items() if q and tokens(key) and within(q, tokens(key)) for k in own]
        return self.ranked(ids, name, relation)[:most]

    def connect(self, a: str, b: str, relation: str) -> None:
        if a == b or self.alike(a, b):
            return
        for x, y in ((a, b), (b, a)):
            if y not in self.near[x]:
                self.near[x].append(y)
        self.kind.setdefault((min(a, b), max(a, b)), relation)

    def endpoints(self, left: list[str], right: list[str], relation: str, names: tuple[str, str]) -> list[tuple[str, str]]:
        left, right = self.ranked(left, names[0], relation), self.ranked(right, names[1], relation)
        modes, most = MODES.get(relation, MODES_ELSE)
        chosen: list[tuple[str, str]] = []

        def best(beam: int, fits) -> tuple[str, str] | None:
            pairs = [(a, b) for a in left[:beam] for b in right[:beam] if a != b and not self.alike(a, b) and fits(a, b)]
            # the first of equal pairs in the order of ranks
            return max(pairs, key=lambda p: self.score(p[0], names[0], relation)[0] + self.score(p[1], names[1], relation)[0], default=None)

        for mode in modes:
            taken = {frozenset(p) for p in chosen}
            kinds = lambda k: self.units[k]["type"]
            pair = best(6, lambda a, b, m=mode, t=taken: frozenset((a, b)) not in t and mode_fits(m, kinds(a), kinds(b)))
            if pair:
                chosen.append(pair)
            if len(chosen) >= most:
                return chosen
        if not chosen and (pair := best(4, lambda a, b: True)):
            chosen.append(pair)
        return chosen

    def edges(self, most: int) -> list[tuple[str, str, str]]:
        """The edges as they came, no unit with more than `most` of them; units in their order give up edges."""
        rank = [EDGE_PRIORITY.get(r, 9) for r in self.kind.values()]
        stands = within_degree(list(self.kind), rank, most, self.units)
        return [(a, b, r) for ((a, b), r), stays in zip(self.kind.items(), stands, strict=True) if stays]


def _sequential(a: str, b: str, relations: list) -> bool:
    """An ENABLES or EXTENDS relation holds between the two names, either way."""
    ta, tb = tokens(a), tokens(b)
    for r in relations:
        f, t = tokens(r["from_concept"]), tokens(r["to_concept"])
        if r["relation"] in ("ENABLES", "EXTENDS") and f and t and ((within(f, ta) and within(t, tb)) or (within(f, tb) and within(t, ta))):
            return True
    return False


def document_edges(units: list, relations: list, hierarchy: list, segments: list = (), most: int = 4) -> list[tuple[str, str, str]]:
    """(a, b, relation) of one document. units in order; relations as told; hierarchy: lists of sibling names."""
    g = Graph({u["ku_id"]: u for u in units})
    by_segment: dict[str, list[str]] = {}
    for k in g.units:
        by_segment.setdefault(k.rpartition("_ku_")[0], []).append(k)
    for s in segments:
        for name in [s["label"], *s["concepts"]]:
            if by_segment.get(s["segment_id"]) and norm(name) and not g.index.get(norm(name)):
                g.index[norm(name)] = g.ranked(by_segment[s["segment_id"]], name)[:2]
    for k, u in g.units.items():
        for e in u["related_kus"] if u["related_kus"] is not None else []:
            for other in g.resolved(e["target_concept"], e["relation"], 1):
                g.connect(k, other, e["relation"])
    for r in relations:
        left, right = (g.resolved(r[c], r["relation"], 3) for c in ("from_concept", "to_concept"))
        if left and right:
            for a, b in g.endpoints(left, right, r["relation"], (r["from_concept"], r["to_concept"])):
                g.connect(a, b, r["relation"])
    for names in hierarchy:
        owns = lambda k, n: any(norm(g.units[k][f]) == norm(n) != "" for f in ("owner_concept", "parent_l2", "concept", "local_concept"))
        groups = [[k for k in g.resolved(n, "SIBLING_OF", 4) if owns(k, n)] for n in names]
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if not groups[i] or not groups[j] or _sequential(names[i], names[j], relations):
                    continue
                a, b = g.ranked(groups[i], names[i], "SIBLING_OF")[0], g.ranked(groups[j], names[j], "SIBLING_OF")[0]
                key = lambda k: norm(g.units[k]["owner_concept"] or g.units[k]["parent_l2"] or g.units[k]["concept"])
                if key(a) and key(a) != key(b):
                    g.connect(a, b, "SIBLING_OF")
    return g.edges(most)
