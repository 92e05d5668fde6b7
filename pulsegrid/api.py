"""The public face of the package."""

from pulsegrid.functions import arrow as functions
from pulsegrid.functions.arrow import register
from pulsegrid.operators import faults, nested, signal, timestamps, units
from pulsegrid.sources.detect import supported_formats
from pulsegrid.sources.reader import decode, describe, detect, files, leads_of, records_of, to_json

__all__ = ["decode", "describe", "detect", "faults", "files", "functions", "leads_of", "nested", "records_of", "register", "signal", "supported_formats", "timestamps", "to_json", "units"]
