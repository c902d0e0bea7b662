

from . import catalog, judging, models  # noqa: F401
