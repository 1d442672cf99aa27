"""Where clouds come from and where indexes go."""

from .clouds import clouds_from_events, clouds_from_lineitem, disturbed, jittered, read_clouds_csv, write_clouds_csv
from .postings_store import load_postings, save_postings

__all__ = ["clouds_from_events", "clouds_from_lineitem", "disturbed", "jittered", "load_postings", "read_clouds_csv", "save_postings", "write_clouds_csv"]
