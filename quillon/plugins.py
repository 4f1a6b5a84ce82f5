"""Plugins: custom operators, id generators, codecs and hooks that hold for all collections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from quillon.errors import PluginError
from quillon.functions.ids import GENERATORS
from quillon.operators.predicate import LOGIC, OPERATORS

HOOKS = ("before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete", "on_change")


@dataclass(frozen=True)
class Plugin:
    name: str
    version: str = "0"
    #: name -> (types or None, (column, operand) -> Column)
    operators: Mapping[str, tuple] = field(default_factory=dict)
    generators: Mapping[str, Callable[[], str]] = field(default_factory=dict)
    codecs: Sequence = ()
    hooks: Mapping[str, Sequence[Callable]] = field(default_factory=dict)
    dependencies: Sequence[str] = ()
    initialize: Callable[[], None] | None = None
    shutdown: Callable[[], None] | None = None


class Registry:
    """What valid plugins bring; initialises them in order, and shuts them down in the opposite one."""

    def __init__(self, plugins: Sequence[Plugin] = (), specs: Mapping | None = None):
        self.plugins, self.operators, self.generators, self.codecs, self.hooks = list(plugins), {}, {}, {}, {}
        names = [p.name for p in plugins]
        for p in plugins:
            if not p.name or not isinstance(p.name, str):
                raise PluginError("a plugin needs a name", plugin=p.name)
            if lost := [d for d in p.dependencies if d not in names]:
                raise PluginError(f"{p.name} needs {', '.join(lost)}", plugin=p.name)
            for op, spec in p.operators.items():
                if not op.startswith("$") or not callable(spec[1]):
                    raise PluginError(f"{p.name}: {op} is no operator", plugin=p.name)
                if op in OPERATORS or op in LOGIC or op in self.operators:
                    raise PluginError(f"{p.name}: {op} exists", plugin=p.name)
                self.operators[op] = spec
            for g, f in p.generators.items():
                if not callable(f):
                    raise PluginError(f"{p.name}: {g} is no generator", plugin=p.name)
                self.generators[g] = f
            for c in p.codecs:
                if not (getattr(c, "extensions", None) and callable(getattr(c, "encode", None)) and callable(getattr(c, "decode", None))):
                    raise PluginError(f"{p.name}: invalid codec", plugin=p.name)
                self.codecs.update(dict.fromkeys(c.extensions, c))
            for point, hooks in p.hooks.items():
                if point not in HOOKS:
                    raise PluginError(f"{p.name}: no hook {point}", plugin=p.name)
                self.hooks.setdefault(point, []).extend(hooks)
        for name, spec in (specs or {}).items():
            g = spec.id_generator
            if isinstance(g, str) and g not in GENERATORS and g not in self.generators:
                raise PluginError(f"{name}: no id generator {g}", collection=name)
        for p in plugins:
            if p.initialize:
                p.initialize()

    def shutdown(self) -> None:
        for p in reversed(self.plugins):
            if p.shutdown:
                p.shutdown()
