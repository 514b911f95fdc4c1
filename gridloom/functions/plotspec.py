"""Plots as plain descriptions: the data side is a Spark aggregate or a bounded thinning, drawing is left to any front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of one curve that go into a description; longer curves are averaged over equal stretches.
POINTS = 2000


class Figures:
    """Numbered figures; each a dict of panels, curves and settings."""

    def __init__(self):
        self.all: dict[int, dict] = {}
        self.now, self.panel = 0, None

    def figure(self, n: int | None = None) -> dict:
        self.now = n if n is not None else max(self.all, default=0) + 1
        self.panel = None
        return self.all.setdefault(self.now, {"panels": {}, "curves": [], "hold": False})

    @property
    def here(self) -> dict:
        fig = self.all.get(self.now) or self.figure()
        return fig["panels"].setdefault(self.panel, {"curves": []}) if self.panel else fig

    def _draw(self, kind: str, x, y, spec: str = "") -> dict:
        if not self.all.get(self.now, {}).get("hold"):
            self.here["curves"] = []
        curve = {"kind": kind, "x": list(x), "y": list(y), "spec": spec}
        self.here["curves"].append(curve)
        return curve

    def plot(self, *args) -> None:
        """plot(y), plot(x, y[, spec]) or several of x, y, spec; a lone y is drawn over 0, 1, ..."""
        args = list(args)
        if len(args) == 1:
            args = [range(len(args[0])), args[0]]
        hold = self.all.setdefault(self.now or self.figure() and self.now, {"panels": {}, "curves": [], "hold": False})["hold"]
        first = True
        while args:
            x, y, *args = args
            spec = args.pop(0) if args and isinstance(args[0], str) else ""
            if not first:
                self.all[self.now]["hold"] = True
            self._draw("line", x, y, spec)
            first = False
        self.all[self.now]["hold"] = hold

    scatter = lambda self, x, y, spec="": self._draw("scatter", x, y, spec)
    bar = lambda self, *xy: self._draw("bar", *(xy if len(xy) == 2 else (range(1, len(xy[0]) + 1), xy[0])))

    def histogram(self, m, bins: int = 10) -> None:
        """Of a Matrix: counted by Spark, only the bins come here."""
        rows = m.hist(bins).orderBy("bin").collect()
        self._draw("bar", [r["bin"] for r in rows], [r["n"] for r in rows])

    hist = histogram

    def _set(self, name: str, value) -> None:
        self.here[name] = value

    title = lambda self, s: self._set("title", s)
    xlabel = lambda self, s: self._set("xlabel", s)
    ylabel = lambda self, s: self._set("ylabel", s)
    legend = lambda self, *s: self._set("legend", list(s))
    grid = lambda self, s="on": self._set("grid", s == "on")
    xlim = lambda self, a, b: self._set("xlim", (a, b))
    ylim = lambda self, a, b: self._set("ylim", (a, b))

    def hold(self, s: str = "on") -> None:
        self.all.setdefault(self.now or 1, {"panels": {}, "curves": [], "hold": False})["hold"] = s == "on"

    def axis(self, limits) -> None:
        a, b, c, d = limits
        self.xlim(a, b)
        self.ylim(c, d)

    def subplot(self, r: int, c: int, k: int) -> None:
        _ = self.here
        self.panel = (r, c, k)

    def clf(self) -> None:
        self.all[self.now] = {"panels": {}, "curves": [], "hold": False}

    def close(self, n: int | None = None) -> None:
        self.all.pop(self.now if n is None else n, None)

    def show(self) -> dict[int, dict]:
        return self.all


def curve_points(df: DataFrame, x: str, y: str, points: int = POINTS) -> DataFrame:
    """At most `points` points of a curve: means over equal stretches of x."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) * points), F.lit(points - 1)))
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("k")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
