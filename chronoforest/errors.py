"""Exceptions with stable codes; findings cover what needn't stop a job."""


class ChronoError(Exception):
    code = 1


class InputError(ChronoError, ValueError):
    code = 3


class CalibrationError(InputError):
    pass


class UsageError(ChronoError, ValueError):
    code = 2


class ExecutionError(ChronoError, RuntimeError):
    code = 1


class ParsingError(ExecutionError):
    pass
