"""Cheapest repair of a sequence of roles by a generalised LR parser over the role grammar.

The parser's stacks share their lower states; after every row, stacks that are equal are merged into the one with the least
(cost, audit). A row is kept, given another role or deleted, and missing rows are inserted before it. What a row does to all
stacks at once depends only on the stacks' relative costs and the order of their audits, so steps are remembered.

Audits of the same rows never are prefixes of each other unless they are equal (every row has one letter of its own, and the
letters between are insertions, which cost), so their order is that of their parents', and small ranks stand for them.
"""

from __future__ import annotations

from functools import lru_cache

#: Productions of the role grammar s?(ua)+ or nothing; the first side is the start.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "ST"), ("S", "s"), ("T", "TP"), ("T", "P"), ("P", "ua"))
ROLES = "sua"  #: initials of system, user, assistant
MADE = "ua"  #: roles that a row can be given and that can be inserted
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A stack that costs more than this above the cheapest can't win: the cheapest can do what it does after one insertion on
#: either side and one deletion.
BEYOND = 2 * INSERT + DELETE

Stack = tuple[frozenset, ...]
Frontier = tuple[tuple[int, int, int], ...]  # (stack's number, cost above the least, rank of its audit)


class Tables:
    """LR(0) item sets, the stacks that can occur, and where each terminal leads from each of them."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = grammar
        self.start = self._closed({(i, 0) for i, (left, _) in enumerate(grammar) if left == grammar[0][0]})
        self.stacks: list[Stack] = [(self.start,)]
        self.moves: list[dict[str, tuple[int, ...]]] = []
        for stack in self.stacks:  # grows
            self.moves.append({t: tuple(self._number(s) for s in self._shifted(stack, t)) for t in ROLES})
        self.final = [any(map(self._done, self._reduced(stack))) for stack in self.stacks]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        for rule, dot in todo:
            right = self.rules[rule][1]
            for i, (left, _) in enumerate(self.rules):
                if dot < len(right) and right[dot] == left and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _goto(self, state: frozenset, symbol: str) -> frozenset | None:
        moved = {(i, dot + 1) for i, dot in state if self.rules[i][1][dot : dot + 1] == symbol}
        return self._closed(moved) if moved else None

    def _reduced(self, stack: Stack) -> list[Stack]:
        """The stack and what reductions make of it; the start's name upon the bottom state marks a complete parse."""
        found = [stack]
        for s in found:
            if isinstance(s[-1], str):
                continue
            for i, dot in s[-1]:
                left, right = self.rules[i]
                if dot == len(right):
                    below = s[: len(s) - dot]
                    state = self._goto(below[-1], left)
                    new = below + ((left,) if state is None else (state,))
                    if new not in found:
                        found.append(new)
        return found

    def _done(self, stack: Stack) -> bool:
        return len(stack) == 2 and stack[1] == self.rules[0][0]

    def _shifted(self, stack: Stack, terminal: str) -> list[Stack]:
        out = []
        for s in self._reduced(stack):
            state = None if isinstance(s[-1], str) else self._goto(s[-1], terminal)
            if state is not None:
                out.append(self._settled(s + (state,)))
        return out

    def _settled(self, stack: Stack) -> Stack:
        """Reductions that are the only thing to do are done."""
        while len(stack[-1]) == 1 and (rule := self.rules[next(iter(stack[-1]))[0]]) and next(iter(stack[-1]))[1] == len(rule[1]):
            below = stack[: len(stack) - len(rule[1])]
            state = self._goto(below[-1], rule[0])
            if state is None:
                break
            stack = below + (state,)
        return stack

    def _number(self, stack: Stack) -> int:
        if stack not in self.stacks:
            self.stacks.append(stack)
        return self.stacks.index(stack)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


#: Kinds of rows: 0 must go; 1 + 2 * (place in ROLES, 3 for others) + truncated.
GONE = 0


def kind(initial: int, truncated: bool) -> int:
    return 1 + 2 * initial + truncated


def _inserted(stack: int) -> dict[int, tuple[int, str]]:
    """Stacks after insertions: number -> (cost, letters)."""
    found = {stack: (0, "")}
    todo = [stack]
    for s in todo:
        cost, letters = found[s]
        for terminal in MADE:
            for to in tables().moves[s][terminal]:
                if to not in found:
                    found[to] = (cost + INSERT, letters + "I")
                    todo.append(to)
    return found


@lru_cache(maxsize=1 << 16)
def step(frontier: Frontier, row: int) -> tuple[int, Frontier, tuple[tuple[int, str], ...]]:
    """What the least cost grows by, the stacks after a row of a kind, and each one's parent (its place) and new letters."""
    initial, extra = divmod(row - 1, 2)
    best: dict[int, tuple[int, int, str, int]] = {}

    def offer(to: int, cost: int, rank: int, letters: str, parent: int) -> None:
        own = (cost, rank, letters, parent)
        if to not in best or own < best[to]:
            best[to] = own

    for place, (stack, cost, rank) in enumerate(frontier):
        offer(stack, cost + DELETE, rank, "D", place)
        if row != GONE:
            for s, (more, letters) in _inserted(stack).items():
                for terminal in ROLES:
                    for to in tables().moves[s][terminal]:
                        if initial < len(ROLES) and terminal == ROLES[initial]:
                            offer(to, cost + more + extra * TRUNCATED, rank, letters + "K", place)
                        if terminal in MADE:
                            offer(to, cost + more + extra * TRUNCATED + REROLE, rank, letters + "R", place)
    least = min(x[0] for x in best.values())
    kept = {s: x for s, x in best.items() if x[0] - least <= BEYOND}
    order = {x: i for i, x in enumerate(sorted({(x[1], x[2]) for x in kept.values()}))}
    numbers = sorted(kept)
    return least, tuple((s, kept[s][0] - least, order[kept[s][1], kept[s][2]]) for s in numbers), tuple((kept[s][3], kept[s][2]) for s in numbers)


def run(entry: int, rows: list[int]) -> tuple[int, Frontier, list]:
    """From one stack through rows (kinds; -m: m rows that must go): the least cost, the stacks, and the way back."""
    cost, frontier, back = 0, ((entry, 0, 0),), []
    for row in rows:
        if row < 0:
            cost -= row * DELETE
            back.append(row)
        else:
            more, frontier, links = step(frontier, row)
            cost += more
            back.append(links)
    return cost, frontier, back


def letters(back: list, place: int) -> str:
    """The audit of the stack at a place of the last frontier."""
    out = []
    for x in reversed(back):
        if isinstance(x, int):
            out.append("D" * -x)
        else:
            place, own = x[place]
            out.append(own)
    return "".join(reversed(out))


def ending(stack: int) -> tuple[int, str] | None:
    """Cost and letters of the insertions that complete a stack."""
    ends = [x for s, x in _inserted(stack).items() if tables().final[s]]
    return min(ends, default=None)


def finish(frontier: Frontier) -> tuple[int, int, str]:
    """The best place of a last frontier, what completing it adds to the least cost, and the letters."""
    ways = [(cost + end[0], rank, end[1], place) for place, (stack, cost, rank) in enumerate(frontier) if (end := ending(stack))]
    cost, _, own, place = min(ways)
    return place, cost, own


def repair(rows: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of several the one with the least audit."""
    cost, frontier, back = run(0, rows)
    place, more, own = finish(frontier)
    return cost + more, letters(back, place) + own
