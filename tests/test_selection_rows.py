"""Intervals of the selection are one row each, whatever the number of levels."""

from clonal_spark.operators import selection


def test_an_interval_is_one_row(spark, monkeypatch):
    counts = []

    class Counted(selection.Scratch):
        def write(self, df, name, **options):
            out = super().write(df, name, **options)
            if name.startswith("ranks-"):
                counts.append((out.count(), out.select("h", "g", "lo", "hi", "base").distinct().count()))
            return out

    monkeypatch.setattr(selection, "Scratch", Counted)
    rows = spark.createDataFrame([(g, float((37 * i + g) % 101)) for g in (1, 2) for i in range(101)], "g long, v double")
    levels = [i / 16 for i in range(1, 16)]
    got = {r.g: r.q for r in selection.exact_quantiles(rows, ["g"], "v", levels, buckets=4, few=3).collect()}
    assert all(abs(x - 100 * level) < 1e-9 for q in got.values() for x, level in zip(q, levels, strict=True)) and len(got) == 2
    assert counts[0] == (2, 2) and all(n == distinct for n, distinct in counts) and len(counts) > 2
