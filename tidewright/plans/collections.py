"""Collections of emulators: flat, expectation and variance, two modes, several waves."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np

from .targets import Ranges, Target


@dataclass(frozen=True)
class Member:
    em: object
    surface: str = "expectation"  # or variance
    mode: int = 0  # 1, 2; 0: no modes
    wave: int = 0

    @property
    def output(self) -> str:
        return self.em.name


@dataclass(frozen=True)
class EmulatorSet:
    members: tuple[Member, ...]
    prop: object | None = None

    @classmethod
    def of(cls, ems) -> EmulatorSet:
        """From an emulator, lists (of lists: waves), {expectation, variance}, or {mode1, mode2, prop}."""
        if isinstance(ems, EmulatorSet):
            return ems
        if isinstance(ems, dict) and "mode1" in ems:
            out = [replace(m, mode=k) for k in (1, 2) for m in cls.of(ems[f"mode{k}"]).members]
            return cls(tuple(out), ems.get("prop"))
        if isinstance(ems, dict) and "expectation" in ems:
            out = [replace(m, surface=s) for s in ("expectation", "variance") for m in cls.of(ems.get(s) or []).members]
            return cls(tuple(out))
        if isinstance(ems, dict):
            ems = list(ems.values())
        if isinstance(ems, Iterable):
            ems = list(ems)
            if any(isinstance(e, (list, tuple, dict, EmulatorSet)) for e in ems):
                out, prop = [], None
                for w, e in enumerate(ems):
                    s = cls.of(e)
                    prop = prop or s.prop
                    out += [replace(m, wave=w) for m in s.members]
                return cls(tuple(out), prop)
            return cls(tuple(Member(e) for e in ems))
        return cls((Member(ems),))

    @property
    def outputs(self) -> list[str]:
        return list(dict.fromkeys(m.output for m in self.members))

    @property
    def kind(self) -> str:
        return "multistate" if any(m.mode for m in self.members) else "variance" if any(m.surface == "variance" for m in self.members) else "flat"

    def subset(self, names: Iterable[str]) -> EmulatorSet:
        keep = set(names)
        return replace(self, members=tuple(m for m in self.members if m.output in keep))

    def recent(self, rest: bool = False) -> EmulatorSet:
        """The first emulator of each output, surface and mode; or the others."""
        seen, first, other = set(), [], []
        for m in self.members:
            k = (m.output, m.surface, m.mode)
            (other if k in seen else first).append(m)
            seen.add(k)
        return replace(self, members=tuple(other if rest else first))

    def ordered(self, z: dict, cutoff: float = 3.0, sample_size: int = 200, seed: int = 0) -> EmulatorSet:
        """Most inputs first, then the most restrictive on random points, then the largest region: cheap rejections come early."""
        rng = np.random.default_rng(seed)

        def rank(m: Member):
            r = m.em.ranges
            pts = np.stack([rng.uniform(a, b, sample_size) for a, b in r.values()], axis=1)
            t = z.get(m.output)
            passed = 0.5 if t is None else float(np.mean(m.em.implausibility(pts, Target.of(t), cutoff)))
            return (-len(r), passed, -float(np.prod([b - a for a, b in r.values()])))

        return replace(self, members=tuple(sorted(self.members, key=rank)))

    def ranges(self, minimal: bool = True) -> Ranges:
        """The narrowest (or widest) range of each input, over the emulators with the most inputs."""
        most = max(len(m.em.ranges) for m in self.members)
        full = [m.em.ranges for m in self.members if len(m.em.ranges) == most]
        lo, hi = (max, min) if minimal else (min, max)
        return {k: (lo(r[k][0] for r in full), hi(r[k][1] for r in full)) for k in full[0]}


def collect_emulators(ems, z: dict | None = None, cutoff: float = 3.0, order: bool = True, sample_size: int = 200) -> EmulatorSet:
    out = EmulatorSet.of(ems)
    return out.ordered(z, cutoff, sample_size) if order and z else out


def subset_emulators(ems, output_names: Iterable[str]) -> EmulatorSet:
    return EmulatorSet.of(ems).subset(output_names)
