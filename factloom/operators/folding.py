"""The order of one group's observations: what each does to the states before it. Names, times and texts have been compared by joins (see ``ingest``)."""

from __future__ import annotations

from collections import defaultdict

from factloom.operators import conflict, linking

ACTIVE = ("CURRENT", "UNCERTAIN")
RESULT = """struct<outcomes array<struct<at int, observation_id string, status string, reason string, stored boolean>>,
states array<struct<at int, status string, uncertainty string, revalidate boolean, confidence double, evidence_ids array<string>, duplicate_of string>>,
relations array<struct<source string, target string, relation_type string, strength string, reason string, evidence_id string, at int>>, stopped boolean>"""
CHANGING = ["status", "uncertainty", "revalidate", "confidence", "evidence_ids", "duplicate_of"]
FIELDS = ("entity", "attribute", "value")


class Group:
    """States by id; ``now`` are those that the observation at hand has changed or brought, as they become."""

    def __init__(self, cells: list, pairs: list, held: list):
        every = {c["state_id"]: c.asDict() for c in cells}
        self.was = {i: s for i, s in every.items() if s["place"] < 0}
        self.new = defaultdict(list)
        for i, s in every.items():
            if s["place"] >= 0:
                self.new[s["place"]].append(s)
        self.pairs = defaultdict(list)
        for p in pairs:
            self.pairs[cells[p["n"]]["state_id"]].append({**p.asDict(), "o_state_id": cells[p["o"]]["state_id"]})
        self.edges = [(e["source"], e["target"], e["strength"]) for e in held]
        self.now, self.touched = {}, set()
        self.masks = {tuple(d[f] is not None for f in FIELDS) for s in every.values() for d in s["depends"]}
        self.subjects, self.slots, self.named, self.versions = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
        for i, s in self.was.items():
            self.listed(i, s)
        self.twins = [(i, j) for ids in self.slots.values() for i in ids for j in ids if i < j and self.meet(i, j)]

    def listed(self, i, s, out=False):
        places = [(self.versions, s["version_id"])]
        if s["status"] in ACTIVE or out:
            places += [(self.subjects, s["entity"]), (self.slots, s["key"])]
            places += [(self.named, (m, tuple(s[f] if g else None for f, g in zip(FIELDS, m, strict=True)))) for m in self.masks]
        for index, key in places:
            index[key].discard(i) if out else index[key].add(i)

    def at(self, i):
        return self.now.get(i) or self.was[i]

    def change(self, i, **to):
        self.now[i] = {**self.at(i), **to}

    def active(self, i):
        return self.at(i)["status"] in ACTIVE

    def meet(self, i, j):
        """Two states of one slot and value at times and under conditions that meet."""
        a, b = self.at(i), self.at(j)
        over = lambda x, y: x["t1"] is not None and y["t0"] is not None and x["t1"] <= y["t0"]
        return not over(a, b) and not over(b, a) and not any(x["key"] == y["key"] and x["value"] != y["value"] for x in a["cond"] for y in b["cond"])

    def links(self, n) -> list:
        """The links of a new state: to the slot of the pool's decisive target, else to all of its slots and to what it names."""
        olds = sorted((p for p in self.pairs[n["state_id"]] if p["o_state_id"] in self.was and self.was[p["o_state_id"]]["status"] in ACTIVE), key=lambda p: (-p["score"], p["o_state_id"]))
        if not olds:
            return []
        # states of the subject that can't be linked are in the pool with score 0
        others = len(self.subjects[n["entity"]]) > sum(self.was[p["o_state_id"]]["entity"] == n["entity"] for p in olds)
        best = olds[0]["score"]
        follow = max([p["score"] for p in olds[1:2]] + [0.0] * others, default=best - linking.LEAD)
        if (best >= 0 or not others) and best - follow >= linking.LEAD:
            target = olds[0]["o_state_id"]
            slot = self.was[target]["slot_id"]
            return [p for p in olds if p["o_state_id"] == target or (p["slot"] and self.was[p["o_state_id"]]["slot_id"] == slot)]
        return [p for p in olds if p["slot"] or p["named"]]

    def revise(self, new: list) -> tuple[list, set]:
        """(relations, what fell) of an observation's new states, as ``conflict.revised`` decides; of those that touch an old one the last decides, but what one of them made stale falls."""
        relations, fell, changes = [], set(), {}
        for n in sorted(new, key=lambda n: (n["sequence_index"], n["state_id"])):
            links = self.links(n)
            kind = lambda p, *k: p["conflict"] in k
            more = lambda p: n["confidence"] > (self.was[p["o_state_id"]]["confidence"] if self.was[p["o_state_id"]]["confidence"] is not None else 2)
            falls = [kind(p, "UPDATE", "IMPLICIT_INVALIDATION") or (kind(p, "EXPLICIT_CONFLICT") and (p["polarity"] or more(p))) for p in links]
            doubt = any(kind(p, "UNCERTAIN") or (kind(p, "EXPLICIT_CONFLICT") and not f) for p, f in zip(links, falls, strict=True))
            ruled = any(kind(p, "UPDATE", "IMPLICIT_INVALIDATION") for p in links)
            same = [p for p in links if kind(p, "DUPLICATE") and self.was[p["o_state_id"]]["status"] == "CURRENT"]
            winner = min(((p["other_field"], *self.order(p["o_state_id"])) for p in same), default=[None])[-1]
            low = n["confidence"] < conflict.UNCERTAIN_BELOW and not ruled
            if winner is None:
                self.now[n["state_id"]] = {**n, "status": "UNCERTAIN" if doubt or low else "CURRENT", "uncertainty": "unresolved_conflict" if doubt else "low_confidence" if low else None}
            for p, f in zip(links, falls, strict=True):
                o = p["o_state_id"]
                was = to = self.was[o]["status"]
                if winner is not None:
                    to = "HISTORICAL" if p in same and o != winner else was
                elif was == "CURRENT":
                    to = "STALE" if f else "HISTORICAL" if p["ended"] else was
                edge = None if winner is not None else "updates" if kind(p, "UPDATE", "TEMPORARY_EXCEPTION") else "invalidates" if f else None
                if edge:
                    relations.append((n["state_id"], o, edge, None, p["conflict"].lower(), n["evidence_ids"][0]))
                if o == winner or to != was:
                    c = changes.setdefault(o, {"evidence": set(), "confidence": []})
                    c["status"], c["into"] = to, winner if winner is not None and o != winner and kind(p, "DUPLICATE") else None
                    if o == winner:
                        c["evidence"].add(n["evidence_ids"][0])
                        c["confidence"].append(n["confidence"])
                    if to == "STALE" and was == "CURRENT":
                        fell.add(o)
        for o, c in changes.items():
            # duplicates that a merge put away leave their evidence with the one that stays
            left = [e for i in sorted(changes) if changes[i]["into"] == o for e in self.was[i]["evidence_ids"]]
            s = self.was[o]
            self.change(o, status="STALE" if o in fell else c["status"], duplicate_of=c["into"] or s["duplicate_of"], evidence_ids=list(dict.fromkeys([*s["evidence_ids"], *left, *sorted(c["evidence"])])), confidence=max([*c["confidence"], *[s["confidence"]] * (s["confidence"] is not None)], default=None))
        return relations, fell

    def order(self, i):
        s = self.at(i)
        return (conflict.FAR if s["observation_index"] is None else s["observation_index"], -1 if s["sequence_index"] is None else s["sequence_index"], i)

    def depend(self, new: list) -> list:
        """Relations of CURRENT new states to the one version of the other CURRENT ones that a selector must name."""
        out = {}
        fresh = [n["state_id"] for n in new if n["state_id"] in self.now]
        for i in fresh:
            s = self.now[i]
            for d in s["depends"] if s["status"] == "CURRENT" else ():
                asked = tuple(d[f] for f in FIELDS)
                near = [x for x in fresh if all(a is None or a == self.now[x][f] for a, f in zip(asked, FIELDS, strict=True))]
                hits = [x for x in {*self.named.get((tuple(a is not None for a in asked), asked), ()), *near} if self.at(x)["status"] == "CURRENT" and self.at(x)["version_id"] != s["version_id"]]
                if len({self.at(x)["version_id"] for x in hits}) == 1 and d["strength"] in ("STRICT", "WEAK"):
                    source = min(hits, key=self.order)
                    out[source, i, d["strength"]] = (source, i, "depends-on", d["strength"], "stated", s["evidence_ids"][0])
        return list(out.values())

    def cascade(self, seeds: set, replacing: set, edges: list) -> list:
        """Relations of what falls with the seeds, by the rules of ``dependency.propagate``."""
        known = lambda i: i in self.now or i in self.was
        of = lambda i: self.at(i)["version_id"]
        edges = [(of(a), of(b), k, a) for a, b, k in edges if known(a) and known(b) and of(a) != of(b)]
        onward, support = defaultdict(set), defaultdict(set)
        shut = {of(i) for i in replacing}
        for a, b, k, source in edges:
            if k == "STRICT":
                onward[a].add(b)
                if b in shut and self.at(source)["status"] == "CURRENT":
                    support[b].add(a)
        reached = {of(i) for i in seeds}
        fallen = dict.fromkeys(reached)
        front = set(reached)
        while front:
            via = {}
            for a in sorted(front):
                for b in onward[a] - reached:
                    via.setdefault(b, a)
            reached |= set(via)
            front = {b for b in via if b not in shut or support[b] - reached}
            fallen |= {b: via[b] for b in front}
        weak = {b for a, b, k, _ in edges if k == "WEAK" and a in fallen and b not in fallen}
        out = []
        brought = defaultdict(set)
        for i, s in self.now.items():
            brought[s["version_id"]].add(i)
        of_version = lambda v: self.versions[v] | brought[v]
        for v, a in fallen.items():
            for i in sorted(of_version(v)):
                if self.active(i):
                    self.change(i, status="STALE")
                    if a is not None:
                        out.append((min(of_version(a)), i, "invalidates", None, "cascade", None))
        for v in weak:
            for i in of_version(v):
                if self.active(i):
                    self.change(i, revalidate=True)
        return out

    def twice(self, new: list) -> bool:
        """Whether two states of one slot and value are active at times and under conditions that meet."""
        fresh = [n["state_id"] for n in new if n["state_id"] in self.now and self.active(n["state_id"])]
        near = lambda i: [*self.slots[self.now[i]["key"]], *[j for j in fresh if j != i and self.now[j]["key"] == self.now[i]["key"]]]
        return any(self.active(j) and self.meet(i, j) for i in fresh for j in near(i)) or any(self.active(i) and self.active(j) for i, j in self.twins)

    def take(self, place: int) -> list | None:
        """The relations that an observation brings; None, and all as it was, where it leaves two active states of one slot."""
        new, self.now = self.new[place], {}
        relations, fell = self.revise(new)
        depends = self.depend(new)
        edges = self.edges + [(a, b, k) for a, b, _, k, *_ in depends]
        if fell:
            relations += self.cascade(fell, {r[0] for r in relations if r[1] in fell}, edges)
        if self.twice(new):
            return None
        for i, s in self.now.items():
            if i in self.was:
                self.listed(i, self.was[i], out=True)
            self.was[i] = s
            self.listed(i, s)
        self.edges = edges
        self.touched |= set(self.now)
        self.now = {}
        return relations + depends


def fold(observations: list, cells: list, pairs: list | None, held: list, broken: list) -> tuple:
    """Outcomes, changed states and relations of one group's observations, in their order up to the first that fails; whether it ended the group.

    ``at`` is a place in ``observations`` or ``cells``. What lies behind an observation that has failed before waits until that one goes in.
    """
    group = Group(cells, pairs or [], held)
    place = {c["state_id"]: i for i, c in enumerate(cells)}
    broken = {b["observation_id"]: b["observation_index"] for b in broken}
    order = sorted(range(len(observations)), key=lambda i: observations[i]["place"])
    outcomes, relations, last, stopped = [], [], observations[order[0]]["last"], False
    for i in order:
        o = observations[i]
        name, index, fault = o["observation_id"], o["observation_index"], o["fault"]
        if broken and (index is None or index > min(broken.values())):
            stopped = True
            continue
        if index is None or index <= last:
            outcomes.append((i, name, "FAILED", "ORDER_GOES_BACK", False))
            stopped = True
            break
        brought = None if fault else group.take(o["place"])
        if brought is None:
            outcomes.append((i, name, "FAILED", fault or "TWO_ACTIVE_STATES_OF_ONE_SLOT", True))
            stopped = True
            break
        outcomes.append((i, name, "COMMITTED", None, True))
        relations += [(*r, i) for r in brought]
        broken.pop(name, None)
        last = index
    states = [(place[i], *[group.was[i][c] for c in CHANGING]) for i in sorted(group.touched)]
    # the same source, target, type, strength and evidence is one relation
    relations = list({(*r[:4], r[5]): r for r in reversed(relations)}.values())
    return outcomes, states, relations, stopped
