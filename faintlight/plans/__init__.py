"""Registered queries; importing this registers all of them."""

from faintlight.plans import families as families
from faintlight.plans import more as more
from faintlight.plans import queries as queries
from faintlight.plans import scanning as scanning
from faintlight.plans import studies as studies
