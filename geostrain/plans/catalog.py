"""All queries; importing this module registers them."""

from . import catalog_scalar  # noqa: F401
from . import catalog_series  # noqa: F401
from . import catalog_solvers  # noqa: F401
from . import catalog_more  # noqa: F401
