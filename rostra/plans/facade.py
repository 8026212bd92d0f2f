"""The engine's queries as calls that return plain records, ready for JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rostra.operators import derived, distribution, profiles, stats
from rostra.schema import DIMS6, YEARS
from rostra.sources.load import records


class Facade:
    """Nine endpoints over one fact, which is cached for as long as the facade is in use."""

    def __init__(self, fact: DataFrame, cached: bool = True):
        self.fact = fact.cache() if cached else fact

    def close(self) -> None:
        self.fact.unpersist()

    def dtypes(self) -> list[dict]:
        return records(profiles.dtypes(self.fact))

    def stats(self, dtype: str = "") -> dict:
        """Rounded as Python rounds, on the one row; zero counts and None for an empty selection."""
        r = records(stats.flat(self.fact, dtype, places=False))[0]
        near = lambda x, k: None if x is None else round(x, k)
        out = {k: r[k] for k in ("n_discourses", "n_countries", "n_leaders", "year_min", "year_max")}
        out["avg_score"] = near(r["avg_score"], 2)
        for t in ("top_country", "top_leader"):
            out[t] = {"name": r[f"{t}_name"], "score": near(r[f"{t}_score"], 1)}
        return out | {"dim_avgs": {d: near(r[d], 2) for d in DIMS6}}

    def countries(self, dtype: str = "") -> list[dict]:
        return records(profiles.countries(self.fact, dtype))

    dim_country = countries

    def yearly_global(self, dtype: str = "") -> list[dict]:
        return records(profiles.yearly_global(self.fact, dtype))

    def yearly(self, countries: str = "", dim: str = "final_score", dtype: str = "") -> list[dict]:
        return records(profiles.yearly(self.fact, countries, dim, dtype))

    def leaders(self, country: str = "ALL", n: int = 25, dtype: str = "") -> list[dict]:
        return records(profiles.leaders(self.fact, country, n, dtype))

    def leader_trend(self, names: str = "", dtype: str = "") -> list[dict]:
        return records(profiles.leader_trend(self.fact, names, dtype))

    def distribution(self, dim: str = "final_score", group: str = "country", year_min: int = YEARS[0], year_max: int = YEARS[1], dtype: str = "") -> list[dict]:
        rows = records(distribution.distribution(self.fact, dim, group, year_min, year_max, dtype, rounded=False))
        rows = [{"group": r["group"], **{k: round(r[k], 2) for k in distribution.FIVE}, "n": r["n"]} for r in rows]
        return sorted(sorted(rows, key=lambda r: r["group"]), key=lambda r: -r["mean"])

    def movers(self, dtype: str = "") -> list[dict]:
        return records(derived.movers(self.fact, dtype))
