

from folianth.plans import checks as _checks  # noqa: F401  registers its queries
from folianth.plans import more as _more  # noqa: F401
