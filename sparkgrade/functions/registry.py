"""Named families of DataFrame functions: a name is registered once, and found by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    def register(self, name: str) -> Callable[[Callable], Callable]:
        """Decorator; ValueError if another function has the name."""

        def put(f: Callable) -> Callable:
            if self.get(name, f) is not f:
                raise ValueError(f"{name} is registered already")
            self[name] = f
            return f

        return put

    def resolve(self, name: str) -> Callable:
        """KeyError with the known names if there is none."""
        if name not in self:
            raise KeyError(f"unknown: {name}; known: {', '.join(sorted(self))}")
        return self[name]


ADVANTAGES, LOSSES, REWARDS, TOOL_PARSERS, SCORERS = Registry(), Registry(), Registry(), Registry(), Registry()


def load_function(path: str, name: str, **fixed) -> Callable:
    """A function of a Python file, with fixed keyword arguments; AttributeError if the file has none of the name."""
    import functools
    import importlib.util

    spec = importlib.util.spec_from_file_location("custom_function", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return functools.partial(getattr(module, name), **fixed)
