"""penprint — source-authorship analytics as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function (or a function
returning ``Column`` expressions).  Randomness is a pure function of
``(seed, tag, ids)`` so results do not depend on partitioning and can be
reproduced by an independent SQL engine.
"""

__version__ = "0.1.0"
