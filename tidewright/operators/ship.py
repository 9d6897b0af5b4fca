"""Broadcasts that may hold functions: user-made emulators, sigmas and kernels."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle

from ..functions import kernels

_BUILT_IN = frozenset(kernels.REGISTRY)
_OPENED: dict[str, object] = {}


class Shipped:
    """A value that tasks read by ``value``; kernels registered by the user travel with it. A worker opens it once."""

    def __init__(self, spark, value):
        own = {k: v for k, v in kernels.REGISTRY.items() if k not in _BUILT_IN}
        self._key = uuid.uuid4().hex
        self._b = spark.sparkContext.broadcast(cloudpickle.dumps((own, value)))

    @property
    def value(self):
        if self._key not in _OPENED:
            own, value = cloudpickle.loads(self._b.value)
            kernels.REGISTRY.update({k: v for k, v in own.items() if k not in kernels.REGISTRY})
            _OPENED.clear()
            _OPENED[self._key] = value
        return _OPENED[self._key]
