"""quillmill: bibliometric analytics and record processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
