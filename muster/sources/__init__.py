"""Reading specs, catalogs and change streams; writing texts, snapshots and reports."""
