"""Small repositories written for the tests."""

PYTHON_REPO = [
    ("shop", "pyproject.toml", """
[project]
name = "shop"
dependencies = ["fastapi>=0.111.0", "pydantic>=2.7.0", "httpx>=0.27.0"]
[project.optional-dependencies]
dev = ["pytest>=8.2.0"]
"""),
    ("shop", "requirements.txt", "fastapi>=0.111.0\n# tools\npydantic>=2.7.0\n\nhttpx>=0.27.0\npytest>=8.2.0\n"),
    ("shop", "src/main.py", "from orders.cart import Cart\nfrom orders.mail import Mail\n\ndef main():\n    import os\n"),
    ("shop", "src/orders/cart.py", "import httpx\nfrom orders.mail import Mail\nimport orders.mail\n"),
    ("shop", "src/orders/mail.py", "import smtplib\nfrom .cart import Cart\n"),
]

NODE_REPO = [
    ("web", "package.json", """{"name": "web", "scripts": {"test": "jest"},
 "dependencies": {"express": "^4.19.2", "jsonwebtoken": "^9.0.2", "empty": ""},
 "devDependencies": {"typescript": "^5.4.5", "express": "*"}}"""),
    ("web", "src/index.ts", "import { Users } from './api/users';\nimport x from 'express';\nimport '../side';\n"),
    ("web", "src/api/users.ts", "import { Store } from '../store';\nimport {\n  a,\n  b } from \"./users\";\n"),
    ("web", "src/store/index.ts", "import out from '../../../outside';\nexport class Store {}\n"),
    ("web", "src/util.js", "import up from '../src/./api/../index.ts'\n"),
]

SQL = """-- demo
CREATE TABLE users (
    id        INTEGER      NOT NULL PRIMARY KEY,
    login     VARCHAR(64)  NOT NULL UNIQUE,
    price     DECIMAL(10, 2) DEFAULT 0,
    note      TEXT
);

create table if not exists `notes` (
    id      INTEGER NOT NULL PRIMARY KEY,
    user_id INTEGER NOT NULL REFERENCES users(id),
    body    TEXT,
    other   INTEGER,
    FOREIGN KEY (other) REFERENCES users (id),
    CONSTRAINT c CHECK (id > 0)
);
CREATE TABLE broken (id INT
"""

SQLALCHEMY = '''"""Models."""
from sqlalchemy import Column, ForeignKey, Integer, String
from sqlalchemy.orm import declarative_base, relationship

Base = declarative_base()


class User(Base):
    __tablename__ = "users"

    id = Column(Integer, primary_key=True, nullable=False)
    login = Column(String(64), nullable=False, unique=True)
    active = Column(Boolean, default=True, nullable=False)
    late = Column(Boolean, nullable=False, default=True)
    _hidden = Column(Integer)

    notes = relationship("Note", back_populates="user")

# a comment does not end a class

class Tag(Base):
    id: Mapped[int] = mapped_column(Integer, primary_key=True)
    user_id = Column(Integer, ForeignKey("users.id"))


class Plain:
    id = Column(Integer)
'''

DJANGO = '''from django.db import models


class Category(models.Model):
    name = models.CharField(max_length=100, unique=True)
    parent = models.ForeignKey("self", null=True, on_delete=models.CASCADE)

    class Meta:
        db_table = "categories"


class Article(
    models.Model
):
    id = models.BigAutoField(primary_key=True)
    category = models.ForeignKey(Category, on_delete=models.CASCADE)
    cover = models.OneToOneField('Image', null=True)
    tags = models.ManyToManyField("Tag")
    place = models.PointField()
'''

PRISMA = """generator client {
  provider = "x"
}

model Product {
  id         Int      @id @default(autoincrement())
  name       String   @unique
  text       String?
  categoryId Int
  category   Category @relation(fields: [categoryId], references: [id])
  items      Item[]
  created    DateTime @default(now())
  kind       Kind
}

model Category {
  id Int @id
}
"""

DB_REPO = [
    ("db", "schema.sql", SQL),
    ("db", "app/models_sa.py", SQLALCHEMY),
    ("db", "app/models_dj.py", DJANGO),
    ("db", "prisma/schema.prisma", PRISMA),
    ("db", "node_modules/x/schema.sql", "CREATE TABLE vendored (\n id INT\n);"),
]

NEGATIVE_REPO = [
    ("none", "a.sql", "SELECT 1;"),
    ("none", "b.py", "x = 1\ndef foo(): pass\n"),
    ("none", "schema.prisma", "generator client {\n  provider = \"x\"\n}\n"),
    ("none", "README.md", "CREATE TABLE readme (\n id INT\n);"),
]
