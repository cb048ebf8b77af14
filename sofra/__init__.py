"""sofra: menu and community analytics as PySpark DataFrame functions."""
