"""What can be refused, and why."""


class AdmissionRejected(ValueError):
    """A tuple that the schema, its identifiers or the graph do not admit."""


class ClosureFanoutExceeded(AdmissionRejected):
    """An edge that would add more closure rows than the store allows."""


class UnloggedWriteRefused(AdmissionRejected):
    """A write to state that a log owns, past the log."""


class SchemaError(ValueError):
    """A schema text or model that cannot be read or compiled."""


class UnsupportedSchema(SchemaError):
    """A schema outside the scope of the compiled engine."""


class DoublyBridgedShape(UnsupportedSchema):
    """A shape that is a wildcard both as subject and as object in a way that would connect all with all."""


class CyclicDerivedDependency(SchemaError):
    """Relations that depend on themselves through a boolean operator."""


class SchemaMismatch(ValueError):
    """A store holds another schema than the one asked for."""


class InvariantViolation(AssertionError):
    """Stored state contradicts itself."""


class StaleRead(RuntimeError):
    """State is older than the token that a reader asks for."""


class LookupNotFresh(StaleRead):
    """A lookup without a state fresh enough, and nothing to fall back on."""


class LogGap(RuntimeError):
    """A log id that a reader has passed over without applying it."""


class LeaseExpired(RuntimeError):
    """A writer took longer than its lease, and its ids were given up; nothing of it was logged."""
