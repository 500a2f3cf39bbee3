"""The statistics document: sections collected from small frames, as JSON and as one HTML page."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.operators import clusters, ingest, similarity, statistics


def _rows(frame: DataFrame, *order: str) -> list[dict]:
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: tuple(str(r[c]) for c in order))


def collect(stored: DataFrame, codes: DataFrame, seeds: DataFrame, effective: DataFrame, ledger: DataFrame) -> dict:
    """Each part is a few rows; the work stays in the frames."""
    built = clusters.sizes(stored, codes).persist()
    alerts = similarity.recheck(stored, codes, seeds, effective)
    sized = codes.select("size", F.size("selectors").alias("selectors"))
    by_edge = lambda frame, column, edges: [r["n"] for r in sorted(statistics.histogram(frame, column, edges).collect(), key=lambda r: r["edge"])]
    by_seed = _rows(statistics.alerts_by_seed(alerts), "seed_address")
    out = {
        "counts": statistics.counts(stored, codes).first().asDict(),
        "levels": _rows(statistics.levels(built, stored), "level"),
        "skeletons": statistics.skeletons(stored, codes).first().asDict(),
        "clusters": {
            "sizes": by_edge(built, "n_members", statistics.CLUSTER_EDGES),
            "top": [{"level": r["level"], "key": r["key"], "members": r["n_members"]} for r in clusters.top(built).collect()],
        },
        "sizes": statistics.distribution(sized, "size").first().asDict() | {"histogram": by_edge(sized, "size", statistics.SIZE_EDGES)},
        "selectors": statistics.distribution(sized, "selectors").first().asDict() | {"histogram": by_edge(sized, "selectors", statistics.SELECTOR_EDGES)},
        "alerts": {"total": sum(r["n"] for r in by_seed), "by_seed": by_seed},
        "risk": _rows(statistics.risk(stored, codes), "flag"),
        "spearman": _rows(statistics.spearman(statistics.features(stored, codes)), "a", "b"),
        "ledger": _rows(ingest.ledger_days(ledger), "day"),
    }
    built.unpersist()
    return out


def _cell(value: object) -> str:
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else html.escape(str(value))


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


_WIDTH, _HEIGHT, _LEFT, _BOTTOM = 640, 240, 64, 48


def _svg(body: list[str], title: str, width: int = _WIDTH, height: int = _HEIGHT) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" font-size="11" font-family="sans-serif"><title>{html.escape(title)}</title>{"".join(body)}</svg>'


def _label(x: float, y: float, text: object, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{html.escape(str(text))}</text>'


def _ticks(top: int, log: bool) -> list[int]:
    if log:
        return [10**k for k in range(len(str(top)))]
    step = 10 ** (len(str(max(1, top))) - 1)
    step = next(s for s in (step // 5 or 1, step // 2 or 1, step, 2 * step) if top / s <= 6)
    return list(range(0, top + step, step))


def bars(counts: list[int], names: list[str], title: str, log: bool = False) -> str:
    """Upright bars over named buckets, with a scale of counts."""
    top = max([1, *counts])
    ticks = _ticks(top, log)
    high = max(top, ticks[-1])
    share = lambda n: (math.log10(n) + 1) / (math.log10(high) + 1) if log and n > 0 else 0.0 if log else n / high
    plot, step = _HEIGHT - _BOTTOM - 24, (_WIDTH - _LEFT - 8) / max(1, len(counts))
    base = 24 + plot
    body = [_label(_WIDTH / 2, 14, title)]
    for t in ticks:
        y = base - plot * share(t)
        body.append(f'<line x1="{_LEFT}" y1="{y:.1f}" x2="{_WIDTH - 8}" y2="{y:.1f}" stroke="#ddd"/>' + _label(_LEFT - 6, y + 4, t, "end"))
    for i, (n, name) in enumerate(zip(counts, names)):
        x, h = _LEFT + i * step + 4, plot * share(n)
        body.append(f'<rect x="{x:.1f}" y="{base - h:.1f}" width="{step - 8:.1f}" height="{h:.1f}" fill="#4477aa"/>' + _label(x + step / 2 - 4, base - h - 4, n) + _label(x + step / 2 - 4, base + 16, name))
    body.append(f'<line x1="{_LEFT}" y1="{base}" x2="{_WIDTH - 8}" y2="{base}" stroke="#333"/>')
    return _svg(body, title)


def lying_bars(counts: list[int], names: list[str], title: str) -> str:
    """Bars from the left, each with its name and count, greatest first."""
    top, row = max([1, *counts]), 18
    body = [_label(_WIDTH / 2, 14, title)]
    for i, (n, name) in enumerate(zip(counts, names)):
        y, w = 24 + i * row, (_WIDTH - 300) * n / top
        body.append(_label(226, y + 12, name, "end") + f'<rect x="232" y="{y}" width="{w:.1f}" height="{row - 4}" fill="#4477aa"/>' + _label(238 + w, y + 12, n, "start"))
    return _svg(body, title, height=32 + row * len(counts))


def heat_map(cells: dict[tuple[str, str], float | None], names: list[str], title: str) -> str:
    """A square of coefficients from -1 (blue) to 1 (red); those that are none are hatched."""
    size, left, top = 64, 120, 40
    body = ['<defs><pattern id="none" width="6" height="6" patternUnits="userSpaceOnUse"><path d="M0 6L6 0" stroke="#888"/></pattern></defs>', _label(left + size * len(names) / 2, 14, title)]
    for i, a in enumerate(names):
        body.append(_label(left - 6, top + size * i + size / 2 + 4, a, "end") + _label(left + size * i + size / 2, top + size * len(names) + 16, a))
        for j, b in enumerate(names):
            rho = cells.get((a, b))
            fill = "url(#none)" if rho is None else f"rgb({round(255 - 160 * max(0.0, -rho))},{round(255 - 160 * abs(rho))},{round(255 - 160 * max(0.0, rho))})"
            body.append(f'<rect x="{left + size * j}" y="{top + size * i}" width="{size}" height="{size}" fill="{fill}" stroke="#fff"/>' + _label(left + size * j + size / 2, top + size * i + size / 2 + 4, _cell(rho)))
    return _svg(body, title, left + size * len(names) + 40, top + size * len(names) + 32)


def _buckets(edges: tuple[int, ...]) -> list[str]:
    return [f"{a}" if b - a == 1 else f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])] + [f"{edges[-1]}+"]


def charts(data: dict) -> dict[str, str]:
    """Five charts of a report's data, by section."""
    rho = {(r["a"], r["b"]): r["rho"] for r in data["spearman"]}
    top = data["clusters"]["top"]
    return {
        "clusters": bars(data["clusters"]["sizes"], _buckets(statistics.CLUSTER_EDGES), "clusters by members", log=True)
        + lying_bars([r["members"] for r in top], [f"{r['level']} {r['key'][:18]}" for r in top], "largest clusters"),
        "sizes": bars(data["sizes"]["histogram"], _buckets(statistics.SIZE_EDGES), "codes by bytes"),
        "selectors": bars(data["selectors"]["histogram"], _buckets(statistics.SELECTOR_EDGES), "codes by selectors"),
        "spearman": heat_map(rho, list(statistics.FEATURES), "rank correlations"),
    }


def render(data: dict) -> str:
    """A page that refers to nothing outside of itself."""
    parts, drawn = [], charts(data)
    for name, section in data.items():
        parts.append(f"<h2>{html.escape(name)}</h2>{drawn.get(name, '')}")
        if isinstance(section, list):
            parts.append(_table(section))
            continue
        plain = {k: v for k, v in section.items() if not isinstance(v, list)}
        parts.append(_table([plain]) if plain else "")
        parts += [_table(v) for v in section.values() if isinstance(v, list) and (not v or isinstance(v[0], dict))]
    return '<!DOCTYPE html><html><head><meta charset="utf-8"><title>report</title></head><body>' + "\n".join(parts) + "</body></html>\n"


def write(data: dict, stem: str) -> tuple[str, str]:
    """The two files of a report; the same data gives the same bytes."""
    texts = {f"{stem}.json": json.dumps(data, sort_keys=True, indent=2) + "\n", f"{stem}.html": render(data)}
    for path, text in texts.items():
        Path(path).write_text(text, encoding="utf-8")
    return tuple(texts)
