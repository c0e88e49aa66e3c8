"""Reports from result dicts: HTML, text, model cards, grades."""

from __future__ import annotations

from html import escape

GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (70, "C"), (60, "D"))


def grade(score: float) -> str:
    return next((g for limit, g in GRADES if score >= limit), "F")


def overall_score(completeness: float | None, issues: int | None) -> float:
    """0.4 of completeness and 0.3 of 100 less 10 an issue, over the weights of what is known."""
    parts = [(0.4, completeness)] if completeness is not None else []
    parts += [(0.3, max(0.0, 100.0 - 10 * issues))] if issues is not None else []
    return sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else 0.0


def weighted_average(metrics: dict, weights: dict[str, float]) -> float:
    """Mean of metrics by weight; nested ones give their overall value, shares of one count as percent."""
    total = used = 0.0
    for name, w in weights.items():
        v = metrics.get(name)
        v = v.get("overall") if isinstance(v, dict) else v
        if v is not None:
            total, used = total + w * (v * 100 if v <= 1 else v), used + w
    return total / used if used else 0.0


def _html(value) -> str:
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        cols = list(dict.fromkeys(k for v in value for k in v))
        head = "".join(f"<th>{escape(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{_html(v.get(c))}</td>" for c in cols) + "</tr>" for v in value)
        return f"<table><tr>{head}</tr>{body}</table>"
    if isinstance(value, dict):
        return "<dl>" + "".join(f"<dt>{escape(str(k))}</dt><dd>{_html(v)}</dd>" for k, v in value.items()) + "</dl>"
    if isinstance(value, float):
        return f"{value:.6g}"
    return escape("" if value is None else str(value))


def html_report(title: str, sections: dict) -> str:
    body = "".join(f"<h2>{escape(str(k))}</h2>{_html(v)}" for k, v in sections.items())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>body{{font:14px sans-serif}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style><h1>{escape(title)}</h1>{body}"


def text_report(title: str, sections: dict) -> str:
    def lines(value, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in ([f"{pad}{k}:"] + lines(v, depth + 1) if isinstance(v, (dict, list)) else [f"{pad}{k}: {v}"])]
        if isinstance(value, list):
            return [f"{pad}- " + ", ".join(f"{k}={x}" for k, x in v.items()) if isinstance(v, dict) else f"{pad}- {v}" for v in value]
        return [f"{pad}{value}"]

    return "\n".join([title, "=" * len(title), *lines(sections, 0)])


def model_card(name: str, facts: dict[str, dict | list | str]) -> str:
    """Markdown with a section a fact."""
    out = [f"# {name}"]
    for k, v in facts.items():
        out.append(f"\n## {k}\n")
        out += [f"- **{a}**: {b}" for a, b in v.items()] if isinstance(v, dict) else [f"- {x}" for x in v] if isinstance(v, list) else [str(v)]
    return "\n".join(out) + "\n"
