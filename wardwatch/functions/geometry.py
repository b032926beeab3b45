"""Column expressions on pose landmarks ``array<struct<x,y,z,vis>>`` and boxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl

VISIBLE = 0.4

# Landmark index of each named joint in the 33-point body model.
BODY_33 = {
    "nose": 0,
    "left_shoulder": 11,
    "right_shoulder": 12,
    "left_elbow": 13,
    "right_elbow": 14,
    "left_wrist": 15,
    "right_wrist": 16,
    "left_hip": 23,
    "right_hip": 24,
    "left_knee": 25,
    "right_knee": 26,
    "left_ankle": 27,
    "right_ankle": 28,
}

# Limb angles as (first, middle, last) joint.
LIMBS = {
    "knee_left": ("left_hip", "left_knee", "left_ankle"),
    "knee_right": ("right_hip", "right_knee", "right_ankle"),
    "elbow_left": ("left_shoulder", "left_elbow", "left_wrist"),
    "elbow_right": ("right_shoulder", "right_elbow", "right_wrist"),
}


class Body:
    """Access to landmarks by joint name."""

    def __init__(self, joints: Mapping[str, int] = BODY_33, column: str = "landmarks"):
        self.joints, self.column = dict(joints), column

    def at(self, joint: str, field: str) -> Column:
        return F.get(F.col(self.column), self.joints[joint])[field]

    def visible(self, names: Sequence[str]) -> Column:
        ok = self.at(names[0], "vis") >= dbl(VISIBLE)
        for n in names[1:]:
            ok = ok & (self.at(n, "vis") >= dbl(VISIBLE))
        return ok

    def mid(self, names: Sequence[str], field: str) -> Column:
        total = self.at(names[0], field)
        for n in names[1:]:
            total = total + self.at(n, field)
        return total / dbl(len(names))

    def joint_angle(self, a: str, b: str, c: str) -> Column:
        """Angle at ``b`` in degrees; NULL if a joint is hidden or a limb has no length."""
        ux, uy = self.at(a, "x") - self.at(b, "x"), self.at(a, "y") - self.at(b, "y")
        wx, wy = self.at(c, "x") - self.at(b, "x"), self.at(c, "y") - self.at(b, "y")
        size = F.sqrt(ux * ux + uy * uy) * F.sqrt(wx * wx + wy * wy)
        return F.when(self.visible([a, b, c]) & (size != 0), _degrees((ux * wx + uy * wy) / size))

    def trunk_tilt(self) -> Column:
        """Angle of the shoulder-to-hip axis against the downward vertical."""
        sh, hp = ["left_shoulder", "right_shoulder"], ["left_hip", "right_hip"]
        dx, dy = self.mid(hp, "x") - self.mid(sh, "x"), self.mid(hp, "y") - self.mid(sh, "y")
        size = F.sqrt(dx * dx + dy * dy)
        return F.when(self.visible([*sh, *hp]) & (size != 0), _degrees(dy / size))

    def torso_height(self) -> Column:
        sh, hp = ["left_shoulder", "right_shoulder"], ["left_hip", "right_hip"]
        return F.when(self.visible([*sh, *hp]), F.abs(self.mid(hp, "y") - self.mid(sh, "y")))

    def hip_center(self, field: str) -> Column:
        hp = ["left_hip", "right_hip"]
        return F.when(self.visible(hp), self.mid(hp, field))

    def body_center(self, field: str) -> Column:
        """Hip centre, else the mean of nose and shoulders, else NULL."""
        upper = ["nose", "left_shoulder", "right_shoulder"]
        return F.coalesce(self.hip_center(field), F.when(self.visible(upper), self.mid(upper, field)))

    def mean(self, field: str) -> Column:
        v = F.transform(self.column, lambda p: p[field])
        return F.aggregate(v, dbl(0), lambda s, x: s + x) / F.size(self.column)


def _degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(dbl(-1), F.least(dbl(1), cosine))))


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes given as struct columns with corner x, y and size w, h."""
    f = lambda s, n: F.col(f"{s}.{n}")
    iw = F.greatest(dbl(0), F.least(f(a, "x") + f(a, "w"), f(b, "x") + f(b, "w")) - F.greatest(f(a, "x"), f(b, "x")))
    ih = F.greatest(dbl(0), F.least(f(a, "y") + f(a, "h"), f(b, "y") + f(b, "h")) - F.greatest(f(a, "y"), f(b, "y")))
    inter = iw * ih
    union = f(a, "w") * f(a, "h") + f(b, "w") * f(b, "h") - inter
    return F.when(union > 0, inter / union).otherwise(dbl(0))
