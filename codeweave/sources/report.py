"""A methods text for a fitted model, and its networks and points as JSON for other tools to draw."""

from __future__ import annotations

import json
from collections.abc import Iterator

from ..model import UNIT, Model

TEXT = """{units} units were modelled over {codes} codes ({code_list}). Lines were grouped into conversations by {conversation}; units were defined by {unit_columns}. Connections were counted {window}, {weight} on each line, and summed for each unit into {connections} {layout} connections.

Networks were scaled to equal length and centered, empty networks at the origin. The first {dims} dimensions of the rotated space ({labels}) hold {shares} of the variance. Codes were placed by least squares so that the centroids of networks lie close to their points.
"""


def methods_report(model: Model) -> str:
    a = model.accumulation
    p = a.parameters
    window = {"Conversation": "over whole conversations", "tensor": "in windows that depend on the lines' factors", "horizons": "in each unit's horizons"}.get(p["window"])
    if window is None:
        back = "all earlier lines" if p["back"] == float("inf") else f"windows of {p['back']:g} lines"
        window = f"in {back}" + (f" and {p['forward']:g} later lines" if p.get("forward") else "")
    return TEXT.format(
        units=model.points.count(),
        codes=len(a.codes),
        code_list=", ".join(a.codes),
        conversation=", ".join(a.conversation),
        unit_columns=", ".join(a.units),
        window=window,
        weight=f"weighted by {p['weight'] if isinstance(p['weight'], str) else 'a function'}",
        connections=len(a.names),
        layout={"ordered": "directed", "self": "undirected (self-connections included)", "unordered": "undirected"}[a.layout],
        dims=len(model.dimensions),
        labels=", ".join(model.dimensions),
        shares=" and ".join(f"{100 * x:.1f} %" for x in model.variance),
    )


def report_stream(model: Model) -> Iterator[str]:
    """The report, a paragraph at a time."""
    yield from (part + "\n" for part in methods_report(model).strip().split("\n\n"))


def write_report(model: Model, path: str) -> None:
    with open(path, "w") as f:
        f.write(methods_report(model))


def export_json(model: Model, path: str) -> None:
    """Nodes and all points, for a viewer; points are written as they stream to the driver, a partition at a time."""
    nodes = [{"code": c, **dict(zip(model.dimensions, map(float, model.rotation.nodes[k])))} for k, c in enumerate(model.rotation.codes)]
    head = {"dimensions": model.dimensions, "variance": [float(v) for v in model.variance], "nodes": nodes}
    with open(path, "w") as f:
        f.write(json.dumps(head)[:-1] + ', "points": [')
        for k, r in enumerate(model.points.orderBy(UNIT).toLocalIterator()):
            f.write((", " if k else "") + json.dumps({"unit": r[UNIT], **{d: r[d] for d in model.dimensions}}))
        f.write("]}")
