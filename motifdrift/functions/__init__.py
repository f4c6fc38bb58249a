"""Part of motifdrift; see README.md."""
