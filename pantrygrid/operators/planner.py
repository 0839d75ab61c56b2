"""Day and menu plans: servings by role, greedy picks, search under targets, swaps, the rest of a day, menus that do not repeat.

A person's day, or whole menu, is planned in one place: attempts, checks and the days before are state of a small loop in
numpy. Everybody is planned from the whole catalogue, at any size of it: a search looks at random places of the lists of
dishes by role, and which places depends on the seed, the person's stream and the lengths of the lists alone. So they are
drawn first, their dishes are joined to them, and a cell holds about ASKS people of one stream and the dishes that they may
look at. Neither grows with its table. One job plans all people and all days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.operators import menus as m
from pantrygrid.operators.dishes import SERVINGS
from pantrygrid.sources import shared_checkpoints

#: The meals of a day with the role that each takes and its share of the day's energy.
MEALS = [("breakfast", "breakfast", 0.25), ("lunch", "main", 0.24), ("lunch, side", "side", 0.09), ("dinner", "main", 0.21), ("dinner, side", "side", 0.09), ("snack", "snack", 0.07), ("snack", "snack", 0.05)]
#: Times that a meal may be over its share, strict and relaxed; weights of meals over it, of wishes and of money; share of wished dishes that is enough.
STRICT, RELAXED, MEAL_WEIGHT, WISH_WEIGHT, WISHES, MONEY_WEIGHT = 2.0, 2.5, 1.5, 0.9, 0.4, 2.2
#: Further attempts, the least energy left that is worth planning, swaps offered and how far they may be from the best, days without repeats.
RETRIES, LEAST_REST, SWAPS, SWAP_MARGIN, VARIETY = 4, 150.0, 5, 1.2, 2
#: Most dishes that a task of a streamed menu holds, people of a cell (dealt by hash: about), portions of an array that swaps are looked for in (about).
HELD, ASKS, OFFERS = 50_000, 512, 4096
#: Streams of draws: people whose number leaves one remainder, and who have one seed, look at the same random places.
STREAMS = 31
#: Dishes seen by a greedy pick and by a step, steps of a search.
GREEDY_SAMPLE, STEP_SAMPLE, STEPS = 120, 40, 150
#: Searches that step side by side; swaps whose other servings may move.
SIDE, TRIALS = 256, 30
GOALS = ["kcal", "protein_g", "fat_g", "carb_g", "fiber_g"]
_ONE = ["grams", *m.NUTRIENTS]
_OFFER = ["dishes", "serving", *_ONE]
_ASK = [*GOALS, "sodium", "budget", "shares", "avoid", "liked", "seed"]
_PLAN = "person long, day int, meal int, dish long, serving double, attempt int, failed int"


def meals() -> Column:
    """The meals of a day as an array of (meal, role, share)."""
    return F.array(*[F.struct(F.lit(i).alias("meal"), F.lit(role).alias("role"), F.lit(share).alias("share")) for i, (_, role, share) in enumerate(MEALS)])


def portions(dishes: DataFrame) -> DataFrame:
    """Every dish in every serving that is neither a crumb nor a basin: grams and nutrients scaled."""
    each = dishes.withColumn("serving", F.explode(F.array(*[F.lit(s) for s in SERVINGS])))
    scaled = {n: F.col(n) * F.col("serving") for n in ["grams", *m.NUTRIENTS]}
    return each.withColumns(scaled).where(F.col("grams").between(*m.PORTION))


def greedy(dishes: DataFrame, people: DataFrame, tolerance: float = STRICT) -> DataFrame:
    """person, meal, dish, serving, kcal: for each meal of people (person, kcal) the portion nearest to its share of the energy, none over tolerance times the share; ties to the smaller dish, then serving."""
    choice = portions(dishes).groupBy("role", "kcal").agg(F.min(F.struct("dish", "serving")).alias("first")).groupBy("role").agg(F.array_sort(F.collect_list(F.struct("kcal", "first.dish", "first.serving"))).alias("choice"))
    # People of one energy have one answer. No side that grows with a table goes to all tasks: files may be far smaller than their rows, and Spark goes by the files.
    asked = people.select(F.col("kcal").alias("ask")).distinct().select("ask", F.explode(meals()).alias("x")).select("ask", "x.*", (F.col("ask") * F.col("x.share")).alias("goal"))
    # One row for each role, with one entry for each energy that its portions have.
    met = asked.join(choice, "role")
    near = F.transform(F.filter("choice", lambda c: c["kcal"] <= F.col("goal") * tolerance), lambda c: F.struct(F.abs(c["kcal"] - F.col("goal")).alias("off"), c["dish"].alias("dish"), c["serving"].alias("serving"), c["kcal"].alias("kcal")))
    best = met.withColumn("best", F.array_min(near)).where("best is not null").select("ask", "meal", "best.dish", "best.serving", "best.kcal")
    return people.select("person", F.col("kcal").alias("ask")).hint("merge").join(best, "ask").select("person", "meal", "dish", "serving", "kcal")


class Pool:
    """What searches know of the catalogue: of each dish in every serving its grams and nutrients, cost (nan: unknown) and whether it is a sane portion.

    Dishes stand in a list for each role, those with a cost first, in order of their ids; rows of one id have one place. So
    who pays draws from the first part of a list.
    """

    def __init__(self, rows: pd.DataFrame, sizes: dict | None = None):
        """rows: known() dishes, all; or, with the lengths of the lists (role, priced), those at some places (at)."""
        if sizes is None:
            rows = rows[rows["role"].notna() & rows["dish"].notna()]
            ids = rows.groupby(["role", "dish"])["cost"].count().gt(0).rename("priced").reset_index().sort_values(["role", "priced", "dish"], ascending=[True, False, True])
            ids["at"] = ids.groupby("role").cumcount()
            sizes = {(role, priced): int(n) for priced, some in ((False, ids), (True, ids[ids["priced"]])) for role, n in some.groupby("role").size().items()}
            rows = rows.merge(ids[["role", "dish", "at"]], on=["role", "dish"])
        self.sizes, self.lists = sizes, {}
        own = rows.assign(free=rows["cost"].isna()).sort_values(["role", "at", "free", *_ONE, "cost"]).reset_index(drop=True)
        self.dish = own["dish"].to_numpy(np.int64)
        cost = own["cost"].to_numpy(float)
        self.x = np.ascontiguousarray(own[_ONE].to_numpy(float).T)[:, :, None] * np.array(SERVINGS)
        self.sane = (self.x[0] >= m.PORTION[0]) & (self.x[0] <= m.PORTION[1])
        self.cost = cost[:, None] * self.x[0]
        self.first, self.count = np.zeros(len(own), np.int64), np.ones((2, len(own)), np.int64)  # of a row's dish: its first row, its rows and those with a cost
        for role, part in own.groupby("role"):
            at, first, count = np.unique(part["at"].to_numpy(np.int64), return_index=True, return_counts=True)
            self.lists[role] = at, first + part.index[0]
            self.first[part.index], self.count[0, part.index] = np.repeat(first + part.index[0], count), np.repeat(count, count)
            self.count[1, part.index] = np.repeat(np.add.reduceat((~part["free"]).to_numpy(np.int64), first), count)
        self.repeats = bool((self.count[0] > 1).any())

    def rows(self, role: str, at: np.ndarray) -> np.ndarray:
        """The first rows of the dishes at places of a list."""
        if not at.size:
            return np.zeros(at.shape, np.int64)
        have, first = self.lists[role]
        i = np.minimum(np.searchsorted(have, at), len(have) - 1)
        if (have[i] != at).any():
            raise KeyError("a place that was not drawn")
        return first[i]

    def every(self, first: np.ndarray, priced: bool) -> np.ndarray:
        """All rows of dishes, or those with a cost, one dish after another, by their first rows."""
        if not self.repeats:
            return first
        count = self.count[int(priced), first]
        return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def known(dishes: DataFrame) -> DataFrame:
    """The columns of dishes that a search reads."""
    return dishes.select("dish", "role", "grams", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in m.NUTRIENTS], F.nanvl(F.col("cost").cast("double"), F.lit(None)).alias("cost"))


def losses(totals: np.ndarray, goals: np.ndarray, sodium: float) -> np.ndarray:
    """The loss of day plans from rows of their nutrients, as day_loss has it in columns."""
    return _losses(totals.T, goals, sodium)


def _losses(totals, goals, sodium) -> np.ndarray:
    """losses() of nutrients in columns; goals may be of one day or of each."""
    out = np.zeros(totals[0].shape)
    for k, (name, weight) in enumerate(m.WEIGHTS.items()):
        asked = goals[k] > 0
        if np.any(asked):
            off = totals[k] / np.where(asked, goals[k], 1.0) - 1
            term = weight * np.abs(off) * np.where(off < 0, m.SHORT.get(name, 1.0), 1.0)
            out += term if np.all(asked) else np.where(asked, term, 0.0)
    out += 3 * np.maximum(totals[6] - sodium, 0) / m.SODIUM
    return out + 3 * np.maximum(totals[5] * 4 / np.maximum(totals[0], 1) - m.SUGAR, 0)


class Draws:
    """The draws of an attempt, places in lists of dishes. They depend on the seed, the stream, the attempt and the lengths of the lists, not on what a person avoids or a search finds, so that people of one stream share them."""

    def __init__(self, sizes: dict, seed: int, stream: int, attempt: int):
        self.sizes, self.key, self.kept = sizes, [x & (2**63 - 1) for x in (seed, stream, attempt)], {}

    def permutation(self, meal: int, priced: bool, n: int) -> np.ndarray:
        """The first n places of a random order of the list of a meal's role. They do not change with n."""
        size, moved, out = self.sizes.get((MEALS[meal][1], priced), 0), {}, []
        u = np.random.default_rng([*self.key, meal]).random(min(n, size)).tolist()
        for i, x in enumerate(u):
            j = i + int(x * (size - i))
            out.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        return np.array(out, np.int64)

    def walk(self, own: tuple[int, ...], priced: bool, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each step the number of its meal among a person's own, whether it looks at other dishes, the places that it then looks at, and draws for what a place leaves open."""
        if ("u", steps) not in self.kept:
            self.kept["u", steps] = np.random.default_rng([*self.key, len(MEALS)]).random((steps, len(MEALS) + 1 + 2 * STEP_SAMPLE))
        u = self.kept["u", steps]
        meal, rest = u[:, list(own)].argmax(axis=1), u[:, len(MEALS) + 1 :]
        size = np.array([self.sizes.get((MEALS[k][1], priced), 0) for k in own])[meal]
        return meal, u[:, len(MEALS)] < 0.5, (rest[:, :STEP_SAMPLE] * size[:, None]).astype(np.int64), rest[:, STEP_SAMPLE:]

    def places(self, shapes: set[tuple[int, ...]], priced: bool, n: int, steps: int) -> dict[str, np.ndarray]:
        """The places of each role's list that people with these meals may look at, where each needs n of a permutation at most."""
        found = {}
        for meal in set().union(*shapes):
            found.setdefault(MEALS[meal][1], []).append(self.permutation(meal, priced, n))
        for own in shapes:
            meal, far, at, _ = self.walk(own, priced, steps)
            for k, i in enumerate(own):
                if self.sizes.get((MEALS[i][1], priced)):
                    found[MEALS[i][1]].append(at[far & (meal == k)].ravel())
        return {role: np.unique(np.concatenate(x)) for role, x in found.items()}

    def rows(self, pool: Pool, meal: int, priced: bool, n: int) -> np.ndarray:
        """permutation() as rows of pool."""
        if (meal, priced, n) not in self.kept:
            self.kept[meal, priced, n] = pool.rows(MEALS[meal][1], self.permutation(meal, priced, n))
        return self.kept[meal, priced, n]

    def steps(self, pool: Pool, own: tuple[int, ...], priced: bool, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """walk() with rows of pool for places; -1 where a step does not look at other dishes."""
        if (own, priced, steps) not in self.kept:
            meal, far, at, u = self.walk(own, priced, steps)
            rows = np.full(at.shape, -1)
            for k, i in enumerate(own):
                some = far & (meal == k)
                rows[some] = pool.rows(MEALS[i][1], at[some])
            self.kept[own, priced, steps] = meal, rows, u
        return self.kept[own, priced, steps]


class _Search:
    """One attempt at one day: a greedy start, and the day as it is."""

    def __init__(self, pool: Pool, ask: dict, tolerance: float, budget: float | None, draws: Draws):
        self.known, self.ask, self.budget, self.draws, self.priced = pool, ask, budget, draws, budget is not None
        self.goals = np.array([ask[g] for g in GOALS], float)
        self.meals = [(i, MEALS[i][1], s) for i, s in enumerate(ask["shares"]) if s]
        self.cap = [s * self.goals[0] * tolerance for _, _, s in self.meals]
        self.at, self.size, self.samples = np.zeros(len(self.meals), np.int64), np.zeros(len(self.meals), np.int64), []
        self.avoid = np.unique(np.array(ask["avoid"], np.int64))

    def start(self) -> bool:
        """Whether every meal found a dish near its share."""
        pool = self.known
        for k, (meal, _, share) in enumerate(self.meals):
            at = self.draws.rows(pool, meal, self.priced, GREEDY_SAMPLE + len(self.avoid) + len(MEALS))
            if len(self.avoid):
                at = at[~np.isin(pool.dish[at], self.avoid)]
            self.samples.append(at[:GREEDY_SAMPLE])
            if k:
                at = at[~np.isin(pool.dish[at], pool.dish[self.at[:k]])]
            if not len(at):
                return False
            at = pool.every(at[:GREEDY_SAMPLE], self.priced)
            kcal = pool.x[1][at].ravel()
            fits = np.flatnonzero(pool.sane[at].ravel() & (kcal <= self.cap[k]))
            if not len(fits):
                return False
            best = fits[np.argmin(np.abs(kcal[fits] - share * self.goals[0]))]
            self.at[k], self.size[k] = at[best // len(SERVINGS)], best % len(SERVINGS)
        return bool(self.meals)

    def walk(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each step the number of the meal, and the rows that it looks at (-1: other servings of the dish at hand). For a dish that is avoided one of the meal's sample stands in, so that each step sees as many."""
        pool = self.known
        meal, at, u = self.draws.steps(pool, tuple(i for i, *_ in self.meals), self.priced, steps)
        if len(self.avoid):
            at = at.copy()
            gone = (at >= 0) & np.isin(pool.dish[at], self.avoid)
            for k, sample in enumerate(self.samples):
                mine = gone & (meal == k)[:, None]
                at[mine] = sample[(u[mine] * len(sample)).astype(np.int64)]
        return meal, np.where(at >= 0, at + (u * pool.count[int(self.priced), at]).astype(np.int64), at) if pool.repeats else at

    def checked(self) -> dict:
        """What judged() says of the day: failed checks, gap of the energy, whether energy and protein are in range."""
        x, dish = self.known.x[:, self.at, self.size].T, self.known.dish[self.at]
        total = np.ascontiguousarray(x[:, 1:]).sum(0)
        off = {n: total[GOALS.index(n)] / self.goals[GOALS.index(n)] - 1 if self.goals[GOALS.index(n)] > 0 else np.inf for n in m.TOLERANCES}
        fits = {n: low <= off[n] <= high for n, (low, high) in m.TOLERANCES.items()}
        fiber = self.goals[4] <= 0 or total[4] >= self.goals[4] * m.FIBER
        sane = (x[:, 0] >= m.PORTION[0]).all() and (x[:, 0] <= m.PORTION[1]).all()
        others = [fiber, total[6] <= self.ask["sodium"], len(set(dish.tolist())) == len(dish), sane]
        return {"failed": int(sum(not x for x in [*fits.values(), *others])), "gap": abs(off["kcal"]), "kcal_ok": fits["kcal"], "protein_ok": fits["protein_g"]}


class _Days:
    """The days of several searches side by side; meals that a search lacks are empty."""

    def __init__(self, pool: Pool, searches: list[_Search]):
        self.pool, n, wide = pool, len(searches), max(len(s.meals) for s in searches)
        self.searches, self.count = searches, np.array([len(s.meals) for s in searches])
        self.at, self.x, self.cost = np.zeros((n, wide), np.int64), np.zeros((8, n, wide)), np.zeros((n, wide))
        self.dish, self.strict, self.cap = np.full((n, wide), np.iinfo(np.int64).min), np.zeros((n, wide)), np.zeros((n, wide))
        for i, s in enumerate(searches):
            k = len(s.meals)
            self.at[i, :k], self.dish[i, :k], self.cap[i, :k] = s.at, pool.dish[s.at], s.cap
            self.x[:, i, :k], self.cost[i, :k] = pool.x[:, s.at, s.size], pool.cost[s.at, s.size]
            self.strict[i, :k] = [share * s.goals[0] * STRICT for _, _, share in s.meals]
        self.goals, self.sodium = np.array([s.goals for s in searches]).T, np.array([s.ask["sodium"] for s in searches], float)
        self.budget = np.array([s.budget or 0.0 for s in searches])
        self.priced = np.array([s.priced for s in searches]).astype(int)
        self.likes = np.array([len(s.ask["liked"]) > 0 for s in searches])
        self.liked = {i: np.isin(pool.dish, s.ask["liked"]) for i, s in enumerate(searches) if self.likes[i]}

    def judged(self, rows: np.ndarray, k: np.ndarray, at: np.ndarray, x: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(within sodium, loss) of the days of rows with each of some portions (x: figures, row, portion; at: their dishes) in meal k."""
        rest, over, paid = np.zeros((7, len(rows))), np.zeros(len(rows)), np.zeros(len(rows))
        for j in range(self.at.shape[1]):  # one meal after another, so that sums are those of a single day
            other = k != j
            rest += np.where(other, self.x[1:, rows, j], 0.0)
            over += np.where(other, np.maximum(self.x[1, rows, j] - self.strict[rows, j], 0), 0.0)
            paid += np.where(other, self.cost[rows, j], 0.0)
        totals, goals = rest[:, :, None] + x[1:], self.goals[:, rows, None]
        loss = _losses(totals, goals, self.sodium[rows, None])
        asked = goals[0] > 0
        over = over[:, None] + np.maximum(x[1] - self.strict[rows, k][:, None], 0)
        loss += np.where(asked, over / np.where(asked, goals[0], 1.0) * MEAL_WEIGHT, 0.0)
        for i in np.flatnonzero(self.likes[rows]):
            liked, own = self.liked[rows[i]], self.at[rows[i], : self.count[rows[i]]]
            share = (np.delete(liked[own], k[i]).sum() + np.repeat(liked[at[i]], x.shape[2] // at.shape[1])) / self.count[rows[i]]
            loss[i] += np.maximum(WISHES - share, 0) / WISHES * WISH_WEIGHT
        some = np.flatnonzero(self.budget[rows])
        loss[some] += np.maximum((paid[some, None] + cost[some]) / self.budget[rows[some], None] - 1, 0) * MONEY_WEIGHT
        return totals[6] <= self.sodium[rows, None], loss

    def others(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rows of the dish in meal k of each of rows: one, but where the catalogue repeats ids."""
        at = self.at[rows, k]
        if not self.pool.repeats:
            return at[:, None]
        first, count = self.pool.first[at], self.pool.count[self.priced[rows], at]
        out = first[:, None] + np.arange(count.max())
        return np.where(out < (first + count)[:, None], out, -1)

    def run(self, steps: int) -> None:
        pool, every = self.pool, np.arange(len(self.searches))
        walks = [s.walk(steps) for s in self.searches]
        meals, seen = np.stack([w[0] for w in walks]), np.stack([w[1] for w in walks])
        ok, loss = self.judged(every, np.zeros(len(every), np.int64), self.at[:, :1], self.x[:, :, :1], self.cost[:, :1])
        best_ok, best = ok[:, 0].copy(), loss[:, 0].copy()
        size = np.stack([np.pad(s.size, (0, self.at.shape[1] - len(s.size))) for s in self.searches])
        for t in range(steps):
            far = seen[:, t, 0] >= 0
            for rows in (np.flatnonzero(far), np.flatnonzero(~far)):
                if not len(rows):
                    continue
                k = meals[rows, t]
                at = seen[rows, t] if far[rows[0]] else self.others(rows, k)
                free = at >= 0
                if far[rows[0]]:
                    taken, mine = self.dish[rows], pool.dish[at]
                    for j in range(taken.shape[1]):
                        free &= (mine != taken[:, j, None]) | (k == j)[:, None]
                x, cost = pool.x[:, at].reshape(8, len(rows), -1), pool.cost[at].reshape(len(rows), -1)
                ok, loss = self.judged(rows, k, at, x, cost)
                fits = (pool.sane[at] & free[:, :, None]).reshape(len(rows), -1) & (x[1] <= self.cap[rows, k][:, None])
                good = fits & ok
                passed = good.any(axis=1)
                pick = np.where(np.where(passed[:, None], good, fits), loss, np.inf).argmin(axis=1)
                line = np.arange(len(rows))
                won = loss[line, pick]
                better = fits.any(axis=1) & ((passed & ~best_ok[rows]) | ((passed == best_ok[rows]) & (won < best[rows])))
                line, pick, own, k = line[better], pick[better], rows[better], k[better]
                best_ok[own], best[own] = passed[better], won[better]
                place = at[line, pick // len(SERVINGS)]
                self.at[own, k], self.dish[own, k], size[own, k] = place, pool.dish[place], pick % len(SERVINGS)
                self.x[:, own, k], self.cost[own, k] = x[:, line, pick], cost[line, pick]
        for i, s in enumerate(self.searches):
            s.at, s.size = self.at[i, : len(s.meals)], size[i, : len(s.meals)]


def best_days(pool: Pool, asks: list[dict], retries: int, steps: int) -> list[tuple[int, int, list[tuple]] | None]:
    """For each ask (person, GOALS, sodium, budget or None, shares, avoid, liked, seed) (attempt, failed checks, [(meal, dish, serving)]) of its best day; None where dishes run out.

    An attempt is searched strictly and with larger meals; the strict day counts if its energy is right, else the nearer
    one. With a budget it is also searched without; that day counts if the other one misses energy or protein. Who fails a
    check is searched again, up to retries times; the day with the fewest failed checks stays, then the nearest, then the
    earliest. Searches step side by side, SIDE at a time, and none depends on the others.
    """
    best, still = [None] * len(asks), list(range(len(asks)))
    for attempt in range(retries + 1):
        tries, drawn = [], {}
        for i in still:
            ask, key = asks[i], (asks[i]["seed"], asks[i]["person"] % STREAMS)
            draws = drawn.setdefault(key, Draws(pool.sizes, *key, attempt))
            for tolerance in (STRICT, RELAXED):
                for budget in (ask["budget"], None) if ask["budget"] and ask["budget"] > 0 else (None,):
                    one = _Search(pool, ask, tolerance, budget, draws)
                    if one.start():
                        tries.append((i, tolerance, budget, one))
        for at in range(0, len(tries), SIDE):
            _Days(pool, [one for *_, one in tries[at : at + SIDE]]).run(steps)
        judged = {}
        for i, tolerance, budget, one in tries:
            c = one.checked()
            broken = 1 if budget is None else 0 if c["kcal_ok"] and c["protein_ok"] else 2
            judged.setdefault(i, []).append(((broken, not (tolerance == STRICT and c["kcal_ok"]), c["gap"], tolerance), c, one))
        for i, found in judged.items():
            _, c, one = min(found, key=lambda t: t[0])
            if best[i] is None or (c["failed"], c["gap"], attempt) < best[i][0]:
                day = zip(one.meals, pool.dish[one.at].tolist(), one.size.tolist())
                best[i] = (c["failed"], c["gap"], attempt), [(meal, dish, SERVINGS[s]) for (meal, _, _), dish, s in day]
            if not c["failed"]:
                still.remove(i)
        if not still:
            break
    return [(b[0][2], b[0][0], b[1]) if b else None for b in best]


def best_day(pool: Pool, ask: dict, retries: int, steps: int) -> tuple[int, int, list[tuple]] | None:
    """best_days of one ask."""
    return best_days(pool, [ask], retries, steps)[0]


def next_days(pool: Pool, asks: list[dict], day: int, recent: list[list[set[int]]], window: int, retries: int, steps: int) -> list[tuple[int, int, list[tuple]] | None]:
    """The day of each ask's menu after its recent ones: a dish does not come again within window days, but for liked ones; where that leaves too few dishes, the day is planned without it."""
    own = [ask | {"seed": ask["seed"] + day} for ask in asks]
    gone = [set().union(*r[-window:]) - set(ask["liked"]) if window and r else set() for ask, r in zip(asks, recent)]
    out = [None] * len(asks)
    some = [i for i in range(len(asks)) if gone[i]]
    for i, got in zip(some, best_days(pool, [own[i] | {"avoid": [*own[i]["avoid"], *sorted(gone[i])]} for i in some], retries, steps)):
        out[i] = got
    rest = [i for i in range(len(asks)) if out[i] is None]
    for i, got in zip(rest, best_days(pool, [own[i] for i in rest], retries, steps)):
        out[i] = got
    return out


def next_day(pool: Pool, ask: dict, day: int, recent: list[set[int]], window: int, retries: int, steps: int) -> tuple[int, int, list[tuple]] | None:
    """next_days of one ask."""
    return next_days(pool, [ask], day, [recent], window, retries, steps)[0]


def ask_of(row: dict) -> dict:
    """A row of people as an ask: lists, and None for no budget."""
    budget = row["budget"]
    return row | {"budget": None if budget is None or np.isnan(budget) else float(budget), **{c: [int(x) for x in row[c]] for c in ("avoid", "liked")}, "seed": int(row["seed"]), "person": int(row["person"])}


def menu(dishes: DataFrame, people: DataFrame, days: int, window: int = VARIETY, retries: int = RETRIES, steps: int = STEPS) -> DataFrame:
    """person, day, meal, dish, serving, attempt, failed: for each of people (person, GOALS; if wanted sodium, budget, shares, avoid, liked, seed) a menu of so many days.

    Nobody gets a day where a role has too few dishes. Plans do not depend on how rows are dealt: they are those of
    next_days with a Pool of the whole catalogue.
    """
    keys = ["seed", "stream"]
    whole = with_defaults(people).select("person", *_ASK).withColumns({"seed": F.col("seed").cast("long"), "stream": F.pmod(F.col("person").cast("long"), F.lit(STREAMS))})
    mine = F.transform("shares", lambda s: F.coalesce(s, F.lit(0.0)) != 0)
    drawn = whole.groupBy(keys).agg(F.collect_set(mine).alias("shapes"), F.max(F.size(F.array_distinct("avoid"))).alias("avoided"), F.max(F.coalesce(F.col("budget") > 0, F.lit(False))).alias("paying"), F.count("*").alias("n"))
    many, most = drawn.agg(F.count("*"), F.max("n")).first()
    side = people.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-(most or 0) // ASKS), min(most or 0, -(-2 * side // max(many, 1))))  # of the people of one stream
    listed, sizes = _lists(dishes)
    past = len(MEALS) * (1 + max(0, min(window, days - 1)))  # dishes that may be taken by other meals, or by the days before

    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shapes = {tuple(i for i, x in enumerate(shape) if x) for shape in row["shapes"]}
                found = {}
                for priced in (False, True)[: 1 + row["paying"]]:
                    for day in range(days):
                        for attempt in range(retries + 1):
                            for role, at in Draws(sizes, row["seed"] + day, row["stream"], attempt).places(shapes, priced, GREEDY_SAMPLE + row["avoided"] + past, steps).items():
                                found.setdefault(role, []).append(at)
                for role, at in found.items():
                    at = np.unique(np.concatenate(at))
                    yield pd.DataFrame({"seed": np.full(len(at), row["seed"], np.int64), "stream": row["stream"], "role": role, "at": at})

    places = drawn.repartition(min(max(many, 1), 2 * side), *keys).mapInPandas(draw, "seed long, stream long, role string, at long")
    rows = places.hint("merge").join(listed.hint("merge"), ["role", "at"]).select(*keys, "role", "at", "dish", F.inline("own"))

    def run(mine: pd.DataFrame, catalogue: pd.DataFrame) -> pd.DataFrame:
        out = []
        asks = [ask_of(row) for row in mine.sort_values("person").to_dict("records")]
        pool = Pool(catalogue, sizes) if asks else None
        recent = [[] for _ in asks]
        for day in range(days if asks else 0):
            for ask, past, got in zip(asks, recent, next_days(pool, asks, day, recent, window, retries, steps)):
                past.append({d for _, d, _ in got[2]} if got else set())
                out += [(ask["person"], day, meal, d, s, got[0], got[1]) for meal, d, s in got[2]] if got else []
        return pd.DataFrame(out, columns=["person", "day", "meal", "dish", "serving", "attempt", "failed"])

    dealt = whole.withColumn("slice", F.pmod(F.xxhash64("person"), F.lit(slices)).cast("int"))
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    deal = lambda df: df.repartition(min(max(many, 1) * slices, 32 * side), *keys, "slice").groupBy(*keys, "slice")
    return deal(dealt).cogroup(deal(rows)).applyInPandas(run, _PLAN)


def _lists(dishes: DataFrame) -> tuple[DataFrame, dict]:
    """The lists that searches draw from, as Pool has them (role, at, dish, own: its rows), and how long they are."""
    roles = sorted({role for _, role, _ in MEALS})
    ids = known(dishes).where(F.col("role").isin(roles) & F.col("dish").isNotNull()).groupBy("role", "dish").agg(F.collect_list(F.struct(*_ONE, "cost")).alias("own"), F.max(F.col("cost").isNotNull()).alias("priced"))
    rows = m.numbered(ids.withColumn("place", F.struct("role", ~F.col("priced"), "dish")), "place", "at")
    found = rows.groupBy("role").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.count_if("priced").alias("some")).collect()  # a row for each role
    start = F.coalesce(*[F.when(F.col("role") == r["role"], F.lit(r["first"])) for r in found], F.lit(0))
    sizes = {(r["role"], False): r["n"] for r in found} | {(r["role"], True): r["some"] for r in found}
    return rows.select("role", (F.col("at") - start).alias("at"), "dish", "own"), sizes


def items(plan: DataFrame, dishes: DataFrame, key: str) -> DataFrame:
    """The items of plans (key, meal, dish, serving) with grams, nutrients and cost."""
    scaled = {n: F.col(n) * F.col("serving") for n in ["grams", *m.NUTRIENTS]}
    met = plan.join(dishes.select("dish", "role", "grams", *m.NUTRIENTS, F.col("cost").alias("gram")).hint("merge"), "dish").withColumns(scaled)
    return met.withColumn("cost", F.col("gram") * F.col("grams")).withColumn("plan", F.col(key))


def judged(plan: DataFrame, dishes: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """key, failed (checks that a plan does not pass), gap (of its energy), kcal_ok, protein_ok, cost (null where a dish has none) for goals (key, GOALS, sodium)."""
    made = items(plan, dishes, key)
    targets = goals.select(F.col(key).alias("plan"), *[F.col(g).alias(f"target_{g}") for g in GOALS])
    checks = m.day_checks(made, targets).drop("sodium_within_limit")
    sums = made.groupBy("plan").agg(F.sum("kcal").alias("kcal"), F.sum("sodium_mg").alias("salt"), F.when(F.count("*") == F.count("cost"), F.sum("cost")).alias("cost"))
    met = checks.join(sums, "plan").join(goals.select(F.col(key).alias("plan"), F.col("kcal").alias("goal"), "sodium"), "plan")
    names = [c for c in checks.columns if c != "plan"]
    failed = sum([(~F.col(c)).cast("int") for c in names], (F.col("salt") > F.col("sodium")).cast("int"))
    return met.select(F.col("plan").alias(key), failed.alias("failed"), F.try_divide(F.abs(F.col("kcal") - F.col("goal")), "goal").alias("gap"), F.col("kcal_in_range").alias("kcal_ok"), F.col("protein_g_in_range").alias("protein_ok"), "cost")


def with_defaults(people: DataFrame) -> DataFrame:
    nothing = F.array().cast("array<long>")
    ask = {"sodium": F.lit(m.SODIUM), "budget": F.lit(None).cast("double"), "shares": F.array(*[F.lit(s) for *_, s in MEALS]), "avoid": nothing, "liked": nothing, "seed": F.lit(0)}
    return people.withColumns({k: v for k, v in ask.items() if k not in people.columns})


def day_plans(dishes: DataFrame, people: DataFrame, retries: int = RETRIES, steps: int = STEPS) -> DataFrame:
    """person, meal, dish, serving, attempt, failed: a day for each of people, as in a menu of one day."""
    return menu(dishes, people, 1, retries=retries, steps=steps).drop("day")


def residual(people: DataFrame, eaten: DataFrame) -> DataFrame:
    """What is left of people's goals after eaten items (person, meal, nutrients, cost): goals, sodium, budget, shares of the meals that are not covered, ids to avoid.

    Whoever has less than LEAST_REST kcal left, or no meal, has no row.
    """
    done = eaten.groupBy("person").agg(*[F.sum(n).alias(f"ate_{n}") for n in m.NUTRIENTS], F.sum("cost").alias("spent"), F.collect_set("meal").alias("covered"), F.collect_set("dish").alias("avoid"))
    met = people.join(done, "person")
    less = lambda a, b: F.greatest(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), F.lit(0.0))
    left = {g: less(F.col(g), F.col(f"ate_{g}")) for g in GOALS} | {"sodium": less(F.lit(m.SODIUM), F.col("ate_sodium_mg"))}
    open_ = F.array(*[F.when(~F.array_contains("covered", i), F.lit(s)).otherwise(0.0) for i, (*_, s) in enumerate(MEALS)])
    out = met.withColumns(left).withColumn("open", open_).withColumn("sum", F.aggregate("open", F.lit(0.0), lambda a, x: a + x))
    budget = {"budget": F.when(F.col("budget") > 0, F.greatest(F.col("budget") - F.coalesce("spent", F.lit(0.0)), F.lit(0.01)))} if "budget" in people.columns else {}
    out = out.where((F.col("sum") > 0) & (F.col("kcal") >= LEAST_REST)).withColumns(budget | {"shares": F.transform("open", lambda x: x / F.col("sum"))})
    return out.select(*people.columns, *[c for c in ("sodium", "shares", "avoid") if c not in people.columns])


def rest_of_day(dishes: DataFrame, people: DataFrame, eaten: DataFrame, **how) -> DataFrame:
    """person, meal, dish, serving: the meals that are not eaten yet, planned for what is left of the day."""
    return day_plans(dishes, residual(people, eaten), **how).drop("attempt", "failed")


def swaps(dishes: DataFrame, plan: DataFrame, goals: DataFrame, meal: int, tune: bool = False) -> DataFrame:
    """person, rank, dish, serving, loss: what may stand for the dish of one meal of plans (person, meal, dish, serving).

    Every other dish of the role in every serving, not over RELAXED times the meal's share, that leaves all eight checks
    passed; of a dish the best serving; at most SWAPS, none over SWAP_MARGIN times the best loss. With tune, the servings
    of the other dishes may move too (one after another, while the day gets better), for those whose best swap is worse
    than SWAP_MARGIN times the day as it is, or who have none.

    People whose day and goals are alike have one answer, found once. Dishes whose figures are alike are judged once, and
    of those only as many are carried on as there are answers (the smallest ids, which come first).
    """
    role = MEALS[meal][1]
    return _swaps(dishes, items(plan, dishes, "person"), goals, meal, _offers(dishes, role), tune)


def _offers(dishes: DataFrame, role: str) -> tuple[int, DataFrame]:
    """How many arrays of about OFFERS portions of a role there are, and the arrays (part, offers)."""
    own = portions(dishes.where(F.col("role") == role).groupBy("grams", *m.NUTRIENTS).agg(F.sort_array(F.collect_set("dish")).alias("dishes")))
    parts = max(1, -(-own.count() // OFFERS))
    return parts, own.withColumn("part", F.pmod(F.xxhash64("dishes", "serving"), F.lit(parts)).cast("int")).groupBy("part").agg(F.collect_list(F.struct(*_OFFER)).alias("offers"))


def _swaps(dishes: DataFrame, made: DataFrame, goals: DataFrame, meal: int, offered: tuple[int, DataFrame], tune: bool) -> DataFrame:
    """swaps() of the items of plans, from the _offers of the meal's role."""
    made, share = made.where(F.col("meal").isNotNull()), MEALS[meal][2]
    sums = [F.sum(F.when(F.col("meal") != meal, F.col(n)).otherwise(0.0)).alias(f"r_{n}") for n in m.NUTRIENTS]
    rest = made.groupBy("person").agg(*sums, F.sort_array(F.collect_set("dish")).alias("taken"), F.min(F.when(F.col("meal") != meal, F.col("grams"))).alias("low"), F.max(F.when(F.col("meal") != meal, F.col("grams"))).alias("high"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("meal") != meal, F.col("dish"))).alias("kinds"), F.sort_array(F.collect_list(F.struct("meal", "dish", "serving", *[F.try_divide(F.col(n), "serving").alias(n) for n in _ONE]))).alias("day"))
    goals = goals.select("person", *[F.col(g).alias(f"target_{g}") for g in GOALS])
    days = rest.join(goals.hint("merge"), "person")
    alike = [c for c in days.columns if c != "person"]
    days = days.withColumn("ask", F.sha2(F.to_json(F.struct(*alike)), 256))
    asks = days.groupBy("ask").agg(*[F.first(c).alias(c) for c in alike])
    parts, offers = offered  # every ask meets each of the arrays, in as many tasks as work side by side
    sides = max(1, -(-2 * made.sparkSession.sparkContext.defaultParallelism // parts))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = F.pmod(F.xxhash64("ask"), F.lit(sides)).cast("int")
    met = asks.withColumn("side", side).withColumn("part", each(parts)).join(offers.withColumn("side", each(sides)).hint("merge"), ["part", "side"])
    energy = [F.col("target_kcal") * (1 + x) - F.col("r_kcal") for x in m.TOLERANCES["kcal"]]  # nothing beyond it passes; a little more than that goes on to the checks
    near = lambda o: F.lit(True) if tune else o["kcal"].between(energy[0] - 1e-6 * F.col("target_kcal"), energy[1] + 1e-6 * F.col("target_kcal"))
    fits = F.filter("offers", lambda o: near(o) & (o["kcal"] <= F.col("target_kcal") * share * RELAXED))
    met = met.withColumn("o", F.explode(fits)).select("*", *[F.col(f"o.{c}").alias(c) for c in _OFFER])
    met = met.withColumn("dish", F.explode(F.slice(F.array_except("dishes", "taken"), 1, TRIALS if tune else SWAPS)))
    day = met.select("ask", "dish", "serving", "day", *[(F.col(f"r_{n}") + F.col(n)).alias(n) for n in m.NUTRIENTS], F.least("low", "grams").alias("least"), F.greatest("high", "grams").alias("most"), (F.col("n") - 1 == F.col("kinds")).alias("distinct"), *[f"target_{g}" for g in GOALS])
    passed = day.where(_passes()).select("ask", "dish", "serving", _loss().alias("loss"))
    if tune:
        whole = lambda n: F.aggregate("day", F.lit(0.0), lambda a, x: a + F.coalesce(x[n] * x["serving"], F.lit(0.0)))
        bars = asks.select("ask", *[whole(n).alias(n) for n in m.NUTRIENTS], *[f"target_{g}" for g in GOALS]).select("ask", (_loss() * SWAP_MARGIN).alias("bar"))
        poor = bars.join(passed.groupBy("ask").agg(F.min("loss").alias("best")), "ask", "left").where("best is null or best > bar").select("ask")
        closest = Window.partitionBy("ask").orderBy(_loss(), "dish", "serving")
        trials = day.join(poor, "ask", "left_semi").withColumn("k", F.row_number().over(closest)).where(F.col("k") <= TRIALS)
        passed = passed.unionByName(_tuned(trials.join(dishes.select(F.col("dish"), F.struct(*_ONE).alias("one")).hint("merge"), "dish"), meal))
    unique = passed.groupBy("ask", "dish").agg(F.min(F.struct("loss", "serving")).alias("b")).select("ask", "dish", "b.serving", "b.loss")
    ranked = unique.withColumn("best", F.min("loss").over(Window.partitionBy("ask"))).where(F.col("loss") <= F.col("best") * SWAP_MARGIN)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.round("loss", 9), "dish"))).where(F.col("rank") <= SWAPS)
    return days.select("person", "ask").hint("merge").join(ranked, "ask").select("person", "rank", "dish", "serving", "loss")


def _passes() -> Column:
    """Whether a row of totals passes the eight checks."""
    ok = F.col("distinct") & (F.col("least") >= m.PORTION[0]) & (F.col("most") <= m.PORTION[1]) & (F.col("sodium_mg") <= m.SODIUM)
    for n, (low, high) in m.TOLERANCES.items():
        ok = ok & F.coalesce((F.when(F.col(f"target_{n}") > 0, F.col(n) / F.col(f"target_{n}") - 1)).between(low, high), F.lit(False))
    return ok & ((F.col("target_fiber_g") <= 0) | (F.col("fiber_g") >= F.col("target_fiber_g") * m.FIBER))


def _loss() -> Column:
    """The loss of a row of totals."""
    out = F.lit(0.0)
    for n, w in m.WEIGHTS.items():
        off = (F.col(n) - F.col(f"target_{n}")) / F.col(f"target_{n}")
        out = out + F.when(F.col(f"target_{n}") > 0, w * F.abs(off) * F.when(off < 0, m.SHORT.get(n, 1.0)).otherwise(1.0)).otherwise(0.0)
    return out + 3 * F.greatest(F.col("sodium_mg") - m.SODIUM, F.lit(0.0)) / m.SODIUM + 3 * F.greatest(F.col("sugar_g") * 4 / F.greatest("kcal", F.lit(1.0)) - m.SUGAR, F.lit(0.0))


def _tuned(trials: DataFrame, meal: int) -> DataFrame:
    """ask, dish, serving, loss of trials (with one, the figures of a portion of the dish) whose other servings were moved until all checks pass."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf.to_dict("records"):
                goals = np.array([t[f"target_{g}"] for g in GOALS], float)
                others = [x for x in t["day"] if x["meal"] != meal]
                day = [(t["dish"], t["serving"])] + [(x["dish"], x["serving"]) for x in others]
                one = np.array([[float(x[n] or 0) for n in _ONE] for x in (t["one"], *others)])
                s = np.array([x[1] for x in day])
                best = losses((one[:, 1:] * s[:, None]).sum(0)[None], goals, m.SODIUM)[0]
                for _ in range(3):
                    before = best
                    for k in range(1, len(day)):
                        tried = np.tile(s, (len(SERVINGS), 1))
                        tried[:, k] = SERVINGS
                        grams = one[k, 0] * np.array(SERVINGS)
                        loss = np.where((grams >= m.PORTION[0]) & (grams <= m.PORTION[1]), losses(tried @ one[:, 1:], goals, m.SODIUM), np.inf)
                        if loss.min() < best:
                            best, s = float(loss.min()), tried[loss.argmin()]
                    if best == before:
                        break
                total, grams = s @ one[:, 1:], s * one[:, 0]
                ranges = all(goals[GOALS.index(n)] > 0 and low <= total[GOALS.index(n)] / goals[GOALS.index(n)] - 1 <= high for n, (low, high) in m.TOLERANCES.items())
                if ranges and total[6] <= m.SODIUM and total[4] >= goals[4] * m.FIBER and grams.min() >= m.PORTION[0] and grams.max() <= m.PORTION[1] and len({d for d, *_ in day}) == len(day):
                    out.append((t["ask"], t["dish"], t["serving"], best))
            yield pd.DataFrame(out, columns=["ask", "dish", "serving", "loss"])

    return trials.select("ask", "dish", "serving", "day", "one", *[f"target_{g}" for g in GOALS]).mapInPandas(run, "ask string, dish long, serving double, loss double")


def repeats_within(eaten: DataFrame, days: int = VARIETY) -> DataFrame:
    """person, day, dish, repeated of eaten (person, day: whole number, dish): whether the dish was there on one of so many days before."""
    daily = eaten.select("person", "day", "dish").distinct()
    before = F.lag("day").over(Window.partitionBy("person", "dish").orderBy("day"))
    return daily.select("person", "day", "dish", F.coalesce(F.col("day") - before <= days, F.lit(False)).alias("repeated"))


#: How far a day is in its band, and how many swaps of one item are tried.
BAND, CHAIN = 0.10, 3


def swap_sweep(dishes: DataFrame, plan: DataFrame, goals: DataFrame, chain: int = CHAIN, tune: bool = False) -> DataFrame:
    """One row on the swaps that plans (person, meal, dish, serving) are offered, place by place, up to chain each: swaps, in_band (share whose four main figures are within BAND), median and p90 (the value at nine tenths) of the new loss over the old one, variety (mean different dishes of a place), short (places with fewer than chain).

    With tune the other servings may have moved too; those days are judged by their loss only, not by in_band.
    """
    shared_checkpoints(plan.sparkSession)
    made = items(plan, dishes, "person").checkpoint()  # seen at each place below
    offers = {role: _offers(dishes, role) for role in {role for _, role, _ in MEALS}}
    offers = {role: (parts, arrays.checkpoint()) for role, (parts, arrays) in offers.items()}
    offered = None
    for meal, (_, role, _) in enumerate(MEALS):
        got = _swaps(dishes, made, goals, meal, offers[role], tune).where(F.col("rank") <= chain).withColumn("meal", F.lit(meal)).checkpoint()  # one place at a time: the plan of all at once fills the driver
        offered = got if offered is None else offered.unionByName(got)
    sums = made.groupBy("person").agg(*[F.sum(n).alias(n) for n in m.NUTRIENTS])
    wanted = goals.select("person", *[F.col(g).alias(f"target_{g}") for g in GOALS])
    old = sums.join(wanted.hint("merge"), "person").select("person", *[F.col(n).alias(f"t_{n}") for n in m.NUTRIENTS], *[f"target_{g}" for g in GOALS], _loss().alias("before"))
    gone = made.select("person", "meal", *[F.col(n).alias(f"o_{n}") for n in m.NUTRIENTS])
    new = dishes.select("dish", *[F.col(n).alias(f"one_{n}") for n in GOALS[:4]])
    met = offered.hint("merge").join(old, "person").join(gone.hint("merge"), ["person", "meal"]).join(new.hint("merge"), "dish")
    near = None
    for g in GOALS[:4]:
        ok = F.when(F.col(f"target_{g}") > 0, F.abs((F.col(f"t_{g}") - F.col(f"o_{g}") + F.col(f"one_{g}") * F.col("serving")) / F.col(f"target_{g}") - 1) <= BAND).otherwise(True)
        near = ok if near is None else near & ok
    each = met.select("person", "meal", "dish", near.alias("near"), (F.col("loss") / F.greatest("before", F.lit(1e-9))).alias("growth")).checkpoint()  # seen four times below
    places = made.select("person", "meal").join(each.groupBy("person", "meal").agg(F.count_distinct("dish").alias("n")).hint("merge"), ["person", "meal"], "left")
    short = places.agg(F.avg("n").alias("variety"), F.count_if(F.coalesce("n", F.lit(0)) < chain).alias("short"))
    whole = each.agg(F.count("*").alias("swaps"), F.avg(F.col("near").cast("int")).alias("in_band"), F.percentile("growth", F.lit(0.5)).alias("median"))
    ninth = m.numbered(each.select("growth"), "growth", "at").join(F.broadcast(whole.select(F.floor(F.col("swaps") * 0.9).alias("at"))), "at").agg(F.max("growth").alias("p90"))  # one row
    return whole.crossJoin(ninth).crossJoin(short).select("swaps", "in_band", "median", "p90", "variety", "short")  # three rows of one


def replayed(dishes: DataFrame, log: DataFrame, **how) -> DataFrame:
    """person, same of a log of days shown (person, GOALS, seed, shown: dishes in order of meals; if it holds them sodium, budget, shares, avoid, liked): whether planning again gives the same dishes. Same means that the catalogue and the search are still those that made the day."""
    again = day_plans(dishes, log.drop("shown"), **how).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("meal", "dish"))), lambda x: x["dish"]).alias("now"))  # seven dishes each
    return log.select("person", "shown").join(again, "person", "left").select("person", F.coalesce(F.col("now") == F.col("shown"), F.lit(False)).alias("same"))
