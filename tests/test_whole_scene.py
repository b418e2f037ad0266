"""Queries without SQL take all cameras and faces, on tables with more than 20 cameras and 800 faces."""

import math
from collections import defaultdict
from pathlib import Path

import pytest

from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_labels_of_all_faces(spark):
    got = [r.node for r in catalogue.queries()["lbp_labels"](spark, FOLDER).collect()]
    assert len(got) > 800 and sorted(got) == sorted(r.f_id for r in catalogue.Scene(spark, FOLDER).faces().collect())


def test_fused_points_of_all_cameras(spark):
    s = catalogue.Scene(spark, FOLDER)
    cams = {r.image_id: r for r in s.cameras().collect()}
    pairs = {tuple(r) for r in catalogue._neighbor_pairs(s).collect()}
    assert {a for a, _ in pairs} == set(cams) and pairs == {(b, a) for a, b in pairs}
    assert len(pairs) <= 2 * 12 * len(cams)
    depth = {(r.image_id, r.r, r.c): r.depth for r in s.depth().collect()}
    near, hits = defaultdict(list), set()
    for a, b in pairs:
        near[a].append(cams[b])
    for (i, r, c), d in depth.items():
        m = cams[i]
        x, y, z = (c - m.px) * d / m.f + m.cx, (r - m.py) * d / m.f + m.cy, d + m.cz
        for n in near[i]:
            if z - n.cz > 0:
                at = (n.image_id, math.floor(n.py + n.f * (y - n.cy) / (z - n.cz) + 0.5), math.floor(n.px + n.f * (x - n.cx) / (z - n.cz) + 0.5))
                if at in depth and abs(z - n.cz - depth[at]) / (z - n.cz) < 0.2:
                    hits.add(((i, r, c), at))
    group = {}
    links = [(a, b) for a, b in hits if (b, a) in hits]
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[a]:
                group[x] = group[a]
    want = set()
    for members in {id(g): g for g in group.values()}.values():
        seed = min(members)
        kept = [p for p in members if abs(depth[seed] - depth[p]) / depth[seed] < 2.0]
        if len({p[0] for p in kept}) >= 2:
            want.add(((seed[0] << 40) + (seed[1] << 20) + seed[2], len({p[0] for p in kept})))
    got = {(r.component, r.views) for r in catalogue.queries()["dense_fuse"](spark, FOLDER).collect()}
    assert got == want and any(component >> 40 >= 20 for component, _ in got)
