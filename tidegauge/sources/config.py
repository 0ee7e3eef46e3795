"""Settings of an evaluation: YAML with inheritance, dotted overrides, checks. On the driver."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

import yaml


@dataclass
class Tail:
    mode: str = "gpd"
    p: float = 0.15
    alpha: float = 0.02
    lam: float = 0.3
    warmup: float = 0.2
    buffer: int = 512
    min_buffer: int = 128
    min_exceedances: int = 8
    momentum: float = 0.05
    shape_min: float = -1.5
    shape_max: float = 0.7
    cap: float | None = None


@dataclass
class Data:
    train: list[str] = field(default_factory=lambda: ["train"])
    held_out: list[str] = field(default_factory=list)
    test: list[str] = field(default_factory=list)
    fraction: float = 0.0


@dataclass
class Config:
    data: Data = field(default_factory=Data)
    tail: Tail = field(default_factory=Tail)
    seed: int = 0
    select: str = "last"

    def check(self) -> Config:
        t = self.tail
        if t.mode not in ("none", "gpd", "cvar", "ohem"):
            raise ValueError(f"unknown tail mode {t.mode!r}")
        if not 0 < t.alpha < t.p <= 1:
            raise ValueError("need 0 < alpha < p <= 1")
        if t.min_buffer > t.buffer:
            raise ValueError("min_buffer is above buffer")
        for a, b in (("train", "held_out"), ("train", "test"), ("held_out", "test")):
            if both := set(getattr(self.data, a)) & set(getattr(self.data, b)):
                raise ValueError(f"{sorted(both)} are in {a} and {b}")
        if self.select == "best" and not (self.data.held_out or self.data.fraction > 0):
            raise ValueError("select=best needs a held-out split")
        return self


def _merge(base: dict, top: dict) -> dict:
    out = dict(base)
    for k, v in top.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _tree(path: str) -> dict:
    with open(path) as f:
        tree = yaml.safe_load(f) or {}
    base = tree.pop("_base", None)
    return _merge(_tree(os.path.join(os.path.dirname(path), base)), tree) if base else tree


def _build(cls, tree: dict):
    kinds = {f.name: f for f in fields(cls)}
    if unknown := set(tree) - set(kinds):
        raise KeyError(f"unknown settings {sorted(unknown)}")
    made = {k: getattr(cls(), k) for k in kinds}
    return cls(**{k: _build(type(made[k]), tree[k]) if is_dataclass(made[k]) else tree[k] for k in tree})


def load(path: str) -> Config:
    return _build(Config, _tree(path)).check()


def override(config: Config, settings: list[str]) -> Config:
    """Apply `a.b=value`; the text takes the type of the present value, and null clears an optional one."""
    for s in settings:
        key, text = s.split("=", 1)
        *path, leaf = key.split(".")
        at = config
        for p in path:
            at = getattr(at, p)
        if not hasattr(at, leaf):
            raise KeyError(key)
        now = getattr(at, leaf)
        value = yaml.safe_load(text)
        if isinstance(now, bool):
            value = bool(value)
        elif isinstance(now, (int, float)) and value is not None:
            value = type(now)(value)
        elif isinstance(now, str):
            value = text
        setattr(at, leaf, value)
    return config.check()


def dump(config: Config, path: str) -> None:
    with open(path, "w") as f:
        yaml.safe_dump(asdict(config), f)
