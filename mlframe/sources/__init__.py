from mlframe.sources.files import (
    load_arrays,
    load_model,
    load_table,
    read_csv,
    read_labelled_files,
    save_arrays,
    save_model,
    write_csv,
)

__all__ = ["load_arrays", "load_model", "load_table", "read_csv", "read_labelled_files",
           "save_arrays", "save_model", "write_csv"]
